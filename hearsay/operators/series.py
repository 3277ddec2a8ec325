"""Volume histograms, spikes against a trailing median, and their overlap with flagged periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the detector: trailing buckets, least volume, and how many times the median counts as a spike.
TRAILING, FLOOR, TIMES = 6, 30, 4.0
#: A sample's peak bucket from which its regime is spiky.
SPIKY = 2 / 3


def histogram(reviews: DataFrame, unit: str = "month") -> DataFrame:
    """Per app contiguous buckets with up and down votes; empty ones count zero.

    The calendar is made from each app's first and last bucket, a row an app, before any window runs.
    """
    start = F.date_trunc(unit, "created_at").cast("timestamp_ntz")
    counted = reviews.withColumn("start", start).groupBy("app_id", "start").agg(F.count_if("voted_up").alias("up"), F.count_if(~F.col("voted_up")).alias("down"))
    step = F.expr(f"interval 1 {unit}")
    calendar = counted.groupBy("app_id").agg(F.min("start").alias("a"), F.max("start").alias("z"))
    calendar = calendar.select("app_id", F.explode(F.sequence("a", "z", step)).alias("start"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return calendar.join(counted, ["app_id", "start"], "left").select("app_id", "start", zero("up"), zero("down"))


def rolled(buckets: DataFrame, unit: str) -> DataFrame:
    """Buckets added up to a coarser unit."""
    start = F.date_trunc(unit, "start").cast("timestamp_ntz")
    return buckets.groupBy("app_id", start.alias("start")).agg(F.sum("up").alias("up"), F.sum("down").alias("down"))


def spikes(buckets: DataFrame, trailing: int = TRAILING, floor: int = FLOOR, times: float = TIMES) -> DataFrame:
    """Buckets with volume, trailing median (null without a full history), ratio and whether they spike."""
    if trailing <= 0 or times <= 0:
        raise ValueError("trailing and times must be positive")
    order = Window.partitionBy("app_id").orderBy("start")
    before = order.rowsBetween(-trailing, -1)
    volume = (F.col("up") + F.col("down")).cast("long")
    out = buckets.withColumn("volume", volume).withColumn("place", F.row_number().over(order))
    median = F.when(F.col("place") > trailing, F.percentile(F.col("volume").cast("double"), 0.5).over(before))
    out = out.withColumn("baseline", median).withColumn("ratio", F.col("volume") / F.nullif(F.col("baseline"), F.lit(0.0)))
    spiked = (F.col("volume") >= floor) & (F.col("baseline") > 0) & (F.col("volume") > times * F.col("baseline"))
    return out.withColumn("spike", F.coalesce(spiked, F.lit(False)))


def episodes(spiked: DataFrame, days: int = 30) -> DataFrame:
    """Runs of consecutive spikes: start, end (of the last bucket), buckets, reviews and the largest ratio."""
    order = Window.partitionBy("app_id").orderBy("start")
    span = F.col("start") - F.lag("start").over(order)
    end = F.coalesce(F.lead("start").over(order), F.col("start") + span, F.col("start") + F.expr(f"interval {days} days"))
    flagged = spiked.withColumn("end", end).filter("spike")
    island = F.col("place") - F.row_number().over(order)
    return flagged.withColumn("island", island).groupBy("app_id", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_buckets"), F.sum("volume").alias("n_reviews"), F.max("ratio").alias("top_ratio")
    ).drop("island")


def flagged_overlap(spans: DataFrame, periods: DataFrame) -> DataFrame:
    """Half-open spans with whether any flagged period of their app overlaps them.

    Spans and periods are rows of one app, so the join is on the app with the interval test behind it.
    """
    p = periods.select(F.col("app_id").alias("p_app"), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    hit = spans.join(p, (F.col("app_id") == F.col("p_app")) & (F.col("start") < F.col("p_end")) & (F.col("end") > F.col("p_start")), "left_semi")
    marks = hit.select("app_id", "start").distinct().withColumn("flagged", F.lit(True))
    return spans.join(marks, ["app_id", "start"], "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))


def period_counts(periods: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviews in each half-open period of their app; periods without any keep zero.

    Periods are a few rows an app and go to the reviews, which are counted where they are read.
    """
    p = periods.select(F.col("app_id").alias("_app"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    inside = (F.col("app_id") == F.col("_app")) & (F.col("created_at") >= F.col("_start")) & (F.col("created_at") < F.col("_end"))
    counts = reviews.select("app_id", "created_at").join(p, inside).groupBy("_app", "_start", "_end").agg(F.count("*").alias("n_reviews"))
    counts = counts.select(F.col("_app").alias("app_id"), F.col("_start").alias("start"), F.col("_end").alias("end"), "n_reviews")
    return periods.join(counts, ["app_id", "start", "end"], "left").withColumn("n_reviews", F.coalesce("n_reviews", F.lit(0)))


def peak_share(buckets: DataFrame) -> DataFrame:
    """Share of the largest bucket in each app's volume, and whether that makes its regime spiky."""
    volume = F.col("up") + F.col("down")
    out = buckets.groupBy("app_id").agg(F.max(volume).alias("peak"), F.sum(volume).alias("total"))
    share = F.col("peak") / F.nullif(F.col("total").cast("double"), F.lit(0.0))
    return out.withColumn("peak_share", share).withColumn("regime", F.when(share >= SPIKY, "spiky").when(share.isNotNull(), "calm"))


def threshold_sweep(spiked: DataFrame, times: list[float], floor: int = FLOOR) -> DataFrame:
    """Per app and factor: buckets, those that would be flagged, and their runs. spiked: what ``spikes`` gives."""
    each = spiked.select("app_id", "place", "volume", "baseline", F.explode(F.array(*map(F.lit, times))).alias("times"))
    hit = F.coalesce((F.col("volume") >= floor) & (F.col("baseline") > 0) & (F.col("volume") > F.col("times") * F.col("baseline")), F.lit(False))
    order = Window.partitionBy("app_id", "times").orderBy("place")
    rows = each.withColumn("hit", hit).withColumn("begins", F.col("hit") & ~F.coalesce(F.lag("hit").over(order), F.lit(False)))
    return rows.groupBy("app_id", "times").agg(F.count("*").alias("buckets"), F.count_if("hit").alias("flagged"), F.count_if("begins").alias("episodes"))
