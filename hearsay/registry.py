"""All registered review-analytics queries, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Each module has QUERIES (name -> callable) and ORACLE (name -> DuckDB SQL).
MODULES: tuple[str, ...] = ("hearsay.plans.marts", "hearsay.plans.selection", "hearsay.plans.series", "hearsay.plans.sampling", "hearsay.plans.journals", "hearsay.plans.evaluation", "hearsay.plans.text", "hearsay.plans.prose", "hearsay.plans.replies", "hearsay.plans.certify", "hearsay.plans.studies", "hearsay.plans.display", "hearsay.plans.doors", "hearsay.plans.lookups", "hearsay.plans.streams", "hearsay.plans.stores", "hearsay.plans.sweeps", "hearsay.plans.workbooks")

Query = Callable[[SparkSession, str], DataFrame]


def _gather(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        for key, value in getattr(import_module(name), attribute).items():
            if key in found:
                raise ValueError(f"{key} is registered twice")
            found[key] = value
    return found


def queries() -> dict[str, Query]:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLE")
