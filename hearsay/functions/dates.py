"""Time expressions; all times are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def iso_text(moment: Column) -> Column:
    """UTC text to the microsecond, whose order is the order of time. A time without a zone must be cast to one before."""
    return F.concat(F.date_format(moment, _ISO), F.lit("+00:00"))


def iso_time(text: Column) -> Column:
    """The time of a text that names its zone; any other text is an error."""
    zoned = text.rlike(r"([+-]\d\d:\d\d|Z)$")
    problem = F.raise_error(F.concat(F.lit("a time without a zone: "), text)).cast("timestamp")
    return F.when(text.isNull(), None).when(zoned, F.to_timestamp(text)).otherwise(problem)


def day_start(moment: Column) -> Column:
    return F.date_trunc("day", moment)


def quota_start(moment: Column, hour: int) -> Column:
    """The latest time of day ``hour`` at or before a moment."""
    shift = F.expr(f"interval {hour} hours")
    return F.date_trunc("day", moment - shift) + shift


def quantile_time(first: Column, last: Column, q: Column) -> Column:
    """The moment at a share of the way from the first to the last."""
    a, z = F.unix_micros(first.cast("timestamp")), F.unix_micros(last.cast("timestamp"))
    return F.timestamp_micros((a + F.round(q * (z - a))).cast("long"))


def elapsed(start: Column, end: Column) -> Column:
    """3m 12s; a dash while there is no end."""
    seconds = F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1_000_000)
    return F.coalesce(F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), F.lpad((seconds % 60).cast("string"), 2, "0"), F.lit("s")), F.lit("—"))


def period_label(start: Column, unit: str) -> Column:
    return F.concat(F.lit("week of "), F.date_format(start, "dd MMM yyyy")) if unit == "week" else F.date_format(start, "MMM yyyy")


def whole_life(first: Column, now: Column) -> tuple[Column, Column]:
    """The window that takes in all of a life: from 45 days before the first populated bucket to a day from now."""
    return F.coalesce(first - F.expr("interval 45 days"), F.lit(0).cast("timestamp").cast("timestamp_ntz")), now + F.expr("interval 1 day")


def year_ticks(first: Column, last: Column) -> Column:
    """The years that begin within a span."""
    return F.when(F.year(last) > F.year(first), F.sequence(F.year(first) + 1, F.year(last))).otherwise(F.array().cast("array<int>"))
