"""The sampling study: errors and intervals of draws, calibration of allowances, floors of contamination, closing verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.functions.intervals import covers, needed_inflation, share_band, shipped, tolerance, wilson
from hearsay.operators.selection import numbered

REGISTER = 0.95


def anchors(buckets: DataFrame, quantiles: list[float]) -> DataFrame:
    """Per app the cutoffs at shares of its life: app_id, quantile, cutoff, pool_size. A cutoff whose pool is the one before
    is left out: pools only grow, so equal sizes are equal pools."""
    populated = buckets.filter("up + down > 0").select("app_id", "start", (F.col("up") + F.col("down")).alias("volume"))
    life = populated.groupBy("app_id").agg(F.min("start").alias("a"), F.max("start").alias("z"))
    q = F.explode(F.array(*map(F.lit, quantiles))).alias("quantile")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    cutoff = F.timestamp_micros((micros("a") + F.round(F.col("quantile") * (micros("z") - micros("a")))).cast("long")).cast("timestamp_ntz")
    grid = life.select("app_id", "a", "z", q).select("app_id", "quantile", cutoff.alias("cutoff"))
    # an app's buckets are few, its reviews are not: the range is tested on buckets
    sized = grid.join(populated, "app_id").filter(F.col("start") <= F.col("cutoff")).groupBy("app_id", "quantile", "cutoff").agg(F.sum("volume").alias("pool_size"))
    return sized.groupBy("app_id", "pool_size").agg(F.min(F.struct("quantile", "cutoff")).alias("x")).select("app_id", "x.quantile", "x.cutoff", "pool_size")


def pools(reviews: DataFrame, grid: DataFrame) -> DataFrame:
    """Reviews as of each anchor: created at or before its cutoff."""
    return reviews.join(grid, "app_id").filter(F.col("created_at") <= F.col("cutoff"))


def draws(members: DataFrame, sizes: list[int], repeats: int, seed: str) -> DataFrame:
    """Uniform draws of each size from each pool (app_id, quantile, pool_size), repeated: app_id, quantile, size, repeat,
    review_id. Cells that would take all are left out. Ranks are of seeded hashes, bounded by the largest size."""
    each = members.select("app_id", "quantile", "pool_size", "review_id", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    place = F.md5(F.concat_ws("|", F.lit(seed), F.col("repeat").cast("string"), "review_id"))
    rank = F.row_number().over(Window.partitionBy("app_id", "quantile", "repeat").orderBy(place, "review_id"))
    ranked = each.withColumn("rank", rank).filter(F.col("rank") <= max(sizes))
    size = F.explode(F.array(*map(F.lit, sizes))).alias("size")
    rows = ranked.select("app_id", "quantile", "pool_size", "repeat", "review_id", "rank", size)
    return rows.filter((F.col("rank") <= F.col("size")) & (F.col("size") < F.col("pool_size"))).drop("rank")


def reference(members: DataFrame, hits: DataFrame) -> DataFrame:
    """Share of each aspect in each pool; aspects that an app has anywhere keep a share of 0. hits: review_id, aspect."""
    sizes = members.groupBy("app_id", "quantile").agg(F.count("*").alias("pool"))
    aspects = members.select("app_id", "review_id").distinct().join(hits, "review_id").select("app_id", "aspect").distinct()
    counts = members.join(hits, "review_id").groupBy("app_id", "quantile", "aspect").agg(F.count("*").alias("k"))
    every = sizes.join(aspects, "app_id").join(counts, ["app_id", "quantile", "aspect"], "left")
    return every.select("app_id", "quantile", "aspect", (F.coalesce("k", F.lit(0)) / F.col("pool")).alias("reference_share"))


def measured(drawn: DataFrame, hits: DataFrame, truth: DataFrame, regime: DataFrame, *more: str) -> DataFrame:
    """Each draw against the truth, for all aspects at once: share, error, interval, band, whether it is covered and within
    the tolerance, and what inflation it would have needed. regime: app_id, regime. more: what else tells cells apart, in drawn
    and, where it has them, in truth."""
    cell = ["app_id", "quantile", "size", "repeat", *more]
    counts = drawn.join(hits, "review_id").groupBy(*cell, "aspect").agg(F.count("*").alias("k"))
    cells = drawn.select(*cell).distinct().join(truth, ["app_id", "quantile", *(c for c in more if c in truth.columns)]).join(counts, [*cell, "aspect"], "left").join(regime, "app_id")
    k, n = F.coalesce("k", F.lit(0)), F.col("size")
    low, high = wilson(k, n)
    ship_low, ship_high = shipped(k, n, F.col("regime"))
    error = F.abs(k / n - F.col("reference_share"))
    band = share_band(F.col("reference_share"))
    limit = tolerance(F.col("regime"), band)
    return cells.select(
        *cell, "aspect", "regime", "reference_share", (k / n).alias("sample_share"), error.alias("error"), (high - low).alias("width"), band.alias("band"),
        covers(low, high, F.col("reference_share")).alias("covered"), covers(ship_low, ship_high, F.col("reference_share")).alias("shipped_covered"),
        (error <= limit).alias("within_tolerance"), needed_inflation(error, high - low).alias("needed"),
    )


def cells(rows: DataFrame, *more: str) -> DataFrame:
    """One row for each cell (more: what else tells them apart) and aspect over its repeats: errors, coverage, mean width."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return rows.groupBy("app_id", "quantile", "size", *more, "aspect").agg(
        F.count("*").alias("repeats"), F.first("reference_share").alias("reference_share"), F.first("band").alias("band"), F.avg("sample_share").alias("mean_share"),
        F.avg("error").alias("mean_error"), F.percentile("error", 0.5).alias("p50_error"), F.percentile("error", 0.9).alias("p90_error"), F.max("error").alias("max_error"),
        rate("covered").alias("coverage"), F.avg("width").alias("mean_width"), rate("within_tolerance").alias("within_rate"), rate("shipped_covered").alias("shipped_rate"),
    )


def flat_allowances(rows: DataFrame, register: float = REGISTER) -> DataFrame:
    """Per regime, and for all regimes together as flat, per band and size: the order statistic of the needed inflation at
    rank ceil(register n), which is a value of the pool, not one between."""
    both = rows.withColumn("regime", F.explode(F.array("regime", F.lit("flat"))))
    return both.groupBy("regime", "band", "size").agg(F.count("*").alias("n"), F.expr(f"percentile_disc({register}) WITHIN GROUP (ORDER BY needed)").alias("allowance"))


def smoothed(allowances: DataFrame) -> DataFrame:
    """Each size's allowance with the largest of it and its neighbours in size."""
    order = Window.partitionBy("regime", "band").orderBy("size")
    near = F.greatest("allowance", F.lag("allowance").over(order), F.lead("allowance").over(order))
    return allowances.withColumn("smoothed", near)


def contaminated(sample: DataFrame, marked: DataFrame, shares: list[float], seed: str) -> DataFrame:
    """Samples of which a share gave way to marked reviews: app_id, share, review_id.

    int(share n + 0.5) reviews of an app's sample leave, by seeded rank, and as many of its marked ones enter. Overlap, a
    pool that is too small, and a share that replaces all are errors.
    """
    n = sample.groupBy("app_id").agg(F.count("*").alias("n"))
    supply = marked.groupBy("app_id").agg(F.count("*").alias("m"))
    twice = sample.select("review_id").intersect(marked.select("review_id")).limit(1).agg(F.count("*").alias("twice"))
    plan = n.join(supply, "app_id").select("app_id", "n", "m", F.explode(F.array(*map(F.lit, shares))).alias("share"))
    plan = plan.withColumn("out", F.floor(F.col("share") * F.col("n") + 0.5)).withColumn("_k", F.lit(1)).join(twice.withColumn("_k", F.lit(1)), "_k").drop("_k")
    trouble = F.when(F.col("twice") > 0, "a review is in the sample and in the marked pool").when(F.col("out") >= F.col("n"), "nothing of the sample would be left").when(F.col("out") > F.col("m"), "too few marked reviews")
    plan = plan.withColumn("out", F.when(trouble.isNotNull(), F.raise_error(trouble).cast("long")).otherwise(F.col("out"))).select("app_id", "share", "out")
    place = lambda tag: F.row_number().over(Window.partitionBy("app_id").orderBy(F.md5(F.concat_ws("|", F.lit(f"{seed}-{tag}"), "review_id")), "review_id"))
    stays = sample.select("app_id", "review_id", place("out").alias("rank")).join(plan, "app_id").filter("rank > out")
    comes = marked.select("app_id", "review_id", place("in").alias("rank")).join(plan, "app_id").filter("rank <= out")
    return stays.unionByName(comes).select("app_id", "share", "review_id")


def register_reads(gates: DataFrame) -> DataFrame:
    """gates (source, share, repeats, within_rate, shipped_rate) -> per source and share the rates, weighted by draws. The
    tolerance's rate is over rows that have one; null without any."""
    w = F.col("repeats").cast("double")
    own = F.when(F.col("within_rate").isNotNull(), w)
    return gates.groupBy("source", "share").agg(
        (F.sum(F.col("within_rate") * w) / F.nullif(F.sum(own), F.lit(0.0))).alias("tolerance_rate"), (F.sum(F.col("shipped_rate") * w) / F.sum(w)).alias("coverage_rate"),
        F.coalesce(F.sum(own), F.lit(0.0)).cast("long").alias("tolerance_draws"), F.sum("repeats").cast("long").alias("coverage_draws"),
    )


def passes(coverage: Column, within: Column, register: float = REGISTER) -> Column:
    """Both promises hold; one that was not made holds."""
    return (coverage >= register) & F.coalesce(within >= register, F.lit(True))


def floors(reads: DataFrame, register: float = REGISTER) -> DataFrame:
    """Per source the last share before the first that fails; null if share 0 fails; censored if none does."""
    order = Window.partitionBy("source").orderBy("share").rowsBetween(Window.unboundedPreceding, 0)
    ok = passes(F.col("coverage_rate"), F.col("tolerance_rate"), register)
    rows = reads.withColumn("ok", ok).withColumn("so_far", F.min(F.col("ok").cast("int")).over(order))
    return rows.groupBy("source").agg(F.max(F.when(F.col("so_far") == 1, F.col("share"))).alias("floor"), F.bool_and("ok").alias("censored"), F.count("*").alias("shares"))


def sampled_reads(closing: DataFrame, *keys: str) -> DataFrame:
    """Cells that were sampled, by keys: rates over cells; those in interval-governed bands have no tolerance."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return closing.filter(~F.col("take_all")).groupBy(*keys).agg(rate("within_tolerance").alias("tolerance_rate"), rate("shipped_covered").alias("coverage_rate"), F.count("within_tolerance").alias("tolerance_cells"), F.count("*").alias("coverage_cells"))


def game_verdicts(closing: DataFrame, register: float = REGISTER) -> DataFrame:
    """Per app: cells that took all must be exact, and the sampled ones, if any, must pass."""
    rate = lambda c: F.avg(F.when(~F.col("take_all"), F.col(c).cast("double")))
    out = closing.groupBy("app_id").agg(
        F.count_if(F.col("take_all") & (F.col("error") == 0)).alias("exact_cells"), F.coalesce(F.bool_and(F.when(F.col("take_all"), F.col("error") == 0)), F.lit(True)).alias("exact"),
        rate("shipped_covered").alias("coverage"), rate("within_tolerance").alias("within"),
    )
    return out.withColumn("passes", F.col("exact") & (F.col("coverage").isNull() | passes(F.col("coverage"), F.col("within"), register)))


def headline_aspects(shares: DataFrame, floor: float = 0.15) -> DataFrame:
    return shares.groupBy("app_id").agg(F.count_if(F.col("share") >= floor).alias("headline_aspects"))


def terciles(rows: DataFrame, value: str, key: str) -> DataFrame:
    """low, middle and high thirds by value, ties by key; what is left over of n // 3 is in the last. One row a unit."""
    rank = F.row_number().over(Window.orderBy(value, key)) - 1
    third = F.floor(F.count("*").over(Window.partitionBy()) / 3)
    return rows.withColumn("third", F.when(rank < third, "low").when(rank < 2 * third, "middle").otherwise("high"))


def drifted(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has: the table's columns and side. Empty when they are exactly equal."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def recomposed(gold: DataFrame, fillers: DataFrame, size: int = 10, seed: str = "r") -> DataFrame:
    """Batches of one gold review and fillers of its app, no filler twice: batch, review_id, is_gold. Gold reviews that an
    app's fillers do not suffice for are topped up from what other apps have left over."""
    hashed = lambda tag: F.md5(F.concat_ws("|", F.lit(f"{seed}-{tag}"), "review_id"))
    need = size - 1
    own = Window.partitionBy("app_id").orderBy(hashed("f"), "review_id")
    g = gold.select("app_id", "review_id", (F.row_number().over(Window.partitionBy("app_id").orderBy("review_id")) - 1).alias("turn"))
    f = fillers.select("app_id", F.col("review_id"), (F.row_number().over(own) - 1).alias("place")).withColumn("turn", F.floor(F.col("place") / need).cast("int"))
    matched = f.join(g.select("app_id", "turn", F.col("review_id").alias("batch")), ["app_id", "turn"], "left")
    used = matched.filter("batch IS NOT NULL").select("batch", "review_id")
    short = g.select(F.col("review_id").alias("batch")).join(used.groupBy("batch").agg(F.count("*").alias("k")), "batch", "left").select("batch", (need - F.coalesce("k", F.lit(0))).alias("short")).filter("short > 0")
    # slots and spare fillers are numbered over all apps; both are as few as the gold reviews
    slots = short.select("batch", F.explode(F.sequence(F.lit(1), F.col("short").cast("int"))).alias("i")).select("batch", F.row_number().over(Window.orderBy("batch", "i")).alias("slot"))
    wanted = slots.agg(F.coalesce(F.max("slot"), F.lit(0)).alias("most"))
    spare = matched.filter("batch IS NULL").select("review_id", hashed("t").alias("h")).withColumn("_k", F.lit(1)).join(wanted.withColumn("_k", F.lit(1)), "_k")
    spare = spare.withColumn("slot", F.row_number().over(Window.orderBy("h", "review_id"))).filter("slot <= most").select("review_id", "slot")
    top = slots.join(spare, "slot").select("batch", "review_id")
    return used.unionByName(top).withColumn("is_gold", F.lit(False)).unionByName(gold.select(F.col("review_id").alias("batch"), "review_id").withColumn("is_gold", F.lit(True)))


def systematic(frame: DataFrame, step: int, start: int, *keys: str) -> DataFrame:
    """Every step-th row of a frame in the order of keys, from a start."""
    at = F.col("_place") - start
    return numbered(frame, list(keys)).filter((at >= 0) & (at % step == 0)).drop("_place")
