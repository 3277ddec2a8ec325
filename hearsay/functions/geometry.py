"""Where the marks of charts go: axes, stacked bars, bucket timelines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def axis_ceiling(edge: Column) -> Column:
    """The least step of a tenth that is not below the widest mark; no more than 1."""
    steps = F.greatest(F.lit(1), F.ceil(F.round(F.least(edge, F.lit(1.0)) / 0.1, 9)))
    return F.least(F.round(steps * 0.1, 2), F.lit(1.0))


def volume_step(peak: Column) -> Column:
    """1, 2 or 5 times a power of ten, at least 1, that gives four marks under the peak at most."""
    raw = peak / F.lit(4.0)
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(raw, F.lit(1.0)))))
    step = F.when(power >= raw, power).when(2 * power >= raw, 2 * power).when(5 * power >= raw, 5 * power).otherwise(10 * power)
    return F.when(raw < 1, F.lit(1)).otherwise(step).cast("long")


def bar_parts(positive: Column, split: Column, negative: Column, size: Column, axis: Column) -> Column:
    """Widths, in percent of the axis, of a bar's parts; parts of nothing are left out."""
    part = lambda kind, n: F.when(n > 0, F.struct(F.lit(kind).alias("kind"), (n * 100.0 / (size * axis)).alias("pct")))
    return F.array_compact(F.array(part("positive", positive), part("split", split), part("negative", negative)))


def along(moment: Column, first: Column, last: Column, width: float) -> Column:
    """Place of a moment on an axis of a width."""
    a, z, m = (F.unix_micros(c.cast("timestamp")) for c in (first, last, moment))
    return (m - a) / F.nullif((z - a).cast("double"), F.lit(0.0)) * width
