"""Time-stratified plans, windowed draws, and how far a draw's shares land from the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plan_windows(buckets: DataFrame, closing: str) -> DataFrame:
    """Populated buckets as half-open windows; an empty bucket still ends the one before it. closing ends the last."""
    order = Window.partitionBy("app_id").orderBy("start")
    end = F.coalesce(F.lead("start").over(order), F.to_timestamp_ntz(F.lit(closing)))
    population = (F.col("up") + F.col("down")).cast("long")
    return buckets.select("app_id", "start", end.alias("end"), population.alias("population")).filter("population > 0")


def apportion(windows: DataFrame, n: int | Column, kind: str = "time-proportional", rounds: int = 40, keys: tuple[str, ...] = ("app_id",)) -> DataFrame:
    """Largest-remainder quotas of n among an app's windows, none above its population; what a full window can't take
    flows to the others. kind equal-per-window weighs all windows alike. keys: what has a plan of its own; n may be one of them.

    Per app the quotas are the floors at a common level, found by bisection over arrays of the app's windows (its
    history's length, not its reviews), then one more for the largest remainders, ties to the earlier window.
    """
    weight = F.col("population").cast("double") if kind == "time-proportional" else F.lit(1.0)
    rows = windows.withColumn("w", weight)
    per_app = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "population", "w"))).alias("ws"))
    total = F.aggregate("ws", F.lit(0).cast("long"), lambda a, x: a + x["population"])
    per_app = per_app.withColumn("n", F.least((n if isinstance(n, Column) else F.lit(n)).cast("long"), total))
    # the level: each window gets min(population, w * level); bisected until the sum is n
    taken = lambda level: F.aggregate("ws", F.lit(0.0), lambda a, x: a + F.least(x["population"].cast("double"), x["w"] * level))
    high = F.aggregate("ws", F.lit(1.0), lambda a, x: F.greatest(a, x["population"] / x["w"]))
    start = F.struct(F.lit(0.0).alias("lo"), high.alias("hi"))

    def halve(acc, _):
        middle = (acc["lo"] + acc["hi"]) / 2
        low = taken(middle) < F.col("n")
        return F.struct(F.when(low, middle).otherwise(acc["lo"]).alias("lo"), F.when(low, acc["hi"]).otherwise(middle).alias("hi"))

    per_app = per_app.withColumn("level", F.aggregate(F.sequence(F.lit(1), F.lit(rounds + 20)), start, halve)["hi"])
    each = per_app.select(*keys, "n", "level", F.inline("ws"))
    ideal = F.round(F.least(F.col("population").cast("double"), F.col("w") * F.col("level")), 6)
    each = each.withColumn("ideal", ideal).withColumn("base", F.floor("ideal"))
    app = Window.partitionBy(*keys)
    short = F.col("n") - F.sum("base").over(app)
    rank = F.row_number().over(app.orderBy((F.col("ideal") - F.col("base")).desc(), "start"))
    quota = (F.col("base") + (rank <= short).cast("long")).cast("long")
    return each.withColumn("quota", quota).select(*keys, "start", "end", "population", "quota")


def windowed_draw(reviews: DataFrame, plan: DataFrame, unit: str = "month") -> DataFrame:
    """The newest reviews of each window up to its quota, by (created_at, review_id) descending.

    A window starts where a bucket does, so reviews meet their window by an equal join on the bucket's start.
    """
    keyed = reviews.withColumn("start", F.date_trunc(unit, "created_at").cast("timestamp_ntz"))
    joined = keyed.join(plan.select("app_id", "start", "quota"), ["app_id", "start"])
    rank = F.row_number().over(Window.partitionBy("app_id", "start").orderBy(F.desc("created_at"), F.desc("review_id")))
    return joined.withColumn("rank", rank).filter("rank <= quota").drop("rank", "quota")


def newest(reviews: DataFrame, n: int) -> DataFrame:
    """The n newest reviews of each app."""
    rank = F.row_number().over(Window.partitionBy("app_id").orderBy(F.desc("created_at"), F.desc("review_id")))
    return reviews.withColumn("rank", rank).filter(F.col("rank") <= n).drop("rank")


def hashed_draw(reviews: DataFrame, n: int, seed: str) -> DataFrame:
    """A uniform draw of n reviews of each app by seeded hash; the same rows whatever their order or partitions."""
    place = F.md5(F.concat(F.lit(seed), F.lit("|"), "review_id"))
    rank = F.row_number().over(Window.partitionBy("app_id").orderBy(place, "review_id"))
    return reviews.withColumn("rank", rank).filter(F.col("rank") <= n).drop("rank")


def shares(members: DataFrame, mentions: DataFrame) -> DataFrame:
    """Per app and pinned aspect the share of members that mention it; aspects that no member mentions have no row."""
    scope = members.select("review_id", "app_id")
    sizes = scope.groupBy("app_id").agg(F.count("*").alias("n"))
    pinned = mentions.filter("slot = 'pinned'").select("review_id", "aspect").distinct()
    hits = pinned.join(scope, "review_id").groupBy("app_id", "aspect").agg(F.count("*").alias("k"))
    return hits.join(sizes, "app_id").select("app_id", "aspect", "k", "n", (F.col("k") / F.col("n")).alias("share"))


def stratified_interval(drawn: DataFrame, plan: DataFrame, hit: str, unit: str = "month", z: float = 1.959963984540054) -> DataFrame:
    """Per app the share of ``hit`` in the whole, estimated from a draw stratified by windows, with a 95 % interval.

    A window weighs by its population; its variance p (1 - p) / max(n - 1, 1) is reduced by the share that was drawn.
    """
    keyed = drawn.withColumn("start", F.date_trunc(unit, "created_at").cast("timestamp_ntz"))
    strata = keyed.groupBy("app_id", "start").agg(F.count("*").alias("n"), F.count_if(hit).alias("k")).join(plan.select("app_id", "start", "population"), ["app_id", "start"])
    weight = F.col("population") / F.sum("population").over(Window.partitionBy("app_id"))
    p = F.col("k") / F.col("n")
    variance = p * (1 - p) / F.greatest(F.col("n") - 1, F.lit(1)) * (1 - F.col("n") / F.col("population"))
    each = strata.select("app_id", "n", (weight * p).alias("wp"), (weight * weight * variance).alias("wv"))
    out = each.groupBy("app_id").agg(F.sum("n").alias("n"), F.sum("wp").alias("estimate"), F.sqrt(F.sum("wv")).alias("error"))
    low, high = F.greatest(F.lit(0.0), F.col("estimate") - z * F.col("error")), F.least(F.lit(1.0), F.col("estimate") + z * F.col("error"))
    return out.select("app_id", "n", "estimate", low.alias("low"), high.alias("high"))


def error_summary(measured: DataFrame) -> DataFrame:
    """Per app over its aspects: mean, median, 90th percentile (linear between ranks) and largest absolute error."""
    e = F.abs("error")
    return measured.groupBy("app_id").agg(
        F.count("*").alias("aspects"), F.avg(e).alias("mean_error"), F.percentile(e, 0.5).alias("p50_error"), F.percentile(e, 0.9).alias("p90_error"), F.max(e).alias("max_error")
    )
