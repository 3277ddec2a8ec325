"""Interval and ratio expressions; undefined stays NULL, never zero."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the two-sided 95 % normal quantile.
Z95 = 1.959963984540054


def ratio(top: Column, bottom: Column) -> Column:
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def wilson(successes: Column, trials: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper Wilson bound, held within 0 and 1; NULL without trials."""
    n = F.nullif(trials.cast("double"), F.lit(0.0))
    p = successes.cast("double") / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    # greatest and least pass over nulls, so they are kept behind the test of n
    return F.when(n.isNotNull(), F.greatest(F.lit(0.0), middle - half)), F.when(n.isNotNull(), F.least(F.lit(1.0), middle + half))


def share_band(share: Column) -> Column:
    """tail under 5 %, mid under 15 %, headline from there."""
    return F.when(share < 0.05, "tail").when(share < 0.15, "mid").when(share.isNotNull(), "headline")


def guarded(successes: Column, trials: Column) -> Column:
    """The successes; counts that don't go together are an error."""
    bad = (trials < 1) | (successes < 0) | (successes > trials)
    message = F.concat_ws(" ", successes.cast("string"), F.lit("successes out of"), trials.cast("string"), F.lit("draws"))
    return F.when(bad, F.raise_error(message).cast("long")).otherwise(successes)


@F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def binomial_bounds(successes: pd.Series, trials: pd.Series) -> pd.DataFrame:
    """The percentiles 2.5 and 97.5 of a resampled proportion: exact binomial quantiles. None and all have no width."""
    low, high = [], []
    for k, n in zip(successes.tolist(), trials.tolist(), strict=True):
        if k in (0, n):
            low.append(k / n)
            high.append(k / n)
            continue
        # all but 1e-30 of the weight lies within a few deviations of k: a window of the order of sqrt(n)
        reach = 12 * math.sqrt(k * (1 - k / n)) + 12
        i = np.arange(max(0, math.floor(k - reach)), min(n, math.ceil(k + reach)) + 1)
        steps = np.log((n - i[:-1]) / (i[:-1] + 1.0)) + math.log(k / n) - math.log1p(-k / n)
        logs = np.concatenate([[0.0], np.cumsum(steps)])
        total = np.cumsum(np.exp(logs - logs.max()))
        at = i[np.minimum(np.searchsorted(total / total[-1], [0.025, 0.975]), len(i) - 1)]
        low.append(at[0] / n)
        high.append(at[1] / n)
    return pd.DataFrame({"low": low, "high": high})


def exact_bounds(rows: DataFrame, successes: str, trials: str) -> DataFrame:
    """rows with exact_low and exact_high; each pair of counts is worked out once."""
    pairs = rows.select(F.col(successes).alias("_k"), F.col(trials).alias("_n")).distinct()
    known = pairs.select("_k", "_n", binomial_bounds("_k", "_n").alias("b")).select("_k", "_n", F.col("b.low").alias("exact_low"), F.col("b.high").alias("exact_high"))
    return rows.join(known, (rows[successes] == known["_k"]) & (rows[trials] == known["_n"])).drop("_k", "_n")


#: What is added to an interval's half-width, and the error that is tolerated, by regime and band.
ALLOWANCES = {("spiky", "mid"): 0.017, ("spiky", "headline"): 0.127}
TOLERANCES = {("calm", "tail"): 0.010, ("calm", "mid"): 0.025, ("spiky", "tail"): 0.010}


def _looked_up(table: dict, regime: Column, band: Column, other: float | None) -> Column:
    out = F.lit(other).cast("double")
    for (r, b), value in table.items():
        out = F.when((regime == r) & (band == b), value).otherwise(out)
    return out


def allowance(regime: Column, band: Column) -> Column:
    return _looked_up(ALLOWANCES, regime, band, 0.0)


def tolerance(regime: Column, band: Column) -> Column:
    """Null where the interval alone is the promise."""
    return _looked_up(TOLERANCES, regime, band, None)


def shipped(successes: Column, trials: Column, regime: Column) -> tuple[Column, Column]:
    """Wilson's bounds, widened by the allowance of the regime and of the sample share's band."""
    low, high = wilson(successes, trials)
    more = allowance(regime, share_band(ratio(successes, trials)))
    return F.greatest(F.lit(0.0), low - more), F.least(F.lit(1.0), high + more)


def covers(low: Column, high: Column, value: Column) -> Column:
    return (low <= value) & (value <= high)


def needed_inflation(error: Column, width: Column) -> Column:
    """What would have to be added to a half-width for the truth to be covered."""
    return F.greatest(F.lit(0.0), error - width / 2)
