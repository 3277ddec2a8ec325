"""The whole sampling sweep in one pass over the pools, and samples blended with marked reviews at many shares.

All sizes and policies share one rank. A window's draw of any plan, and the newest reviews of a pool, are the first reviews of each
month in the same order, so each pool's month is ranked once, every plan becomes a quota for it (the newest n by what the later
months hold), and a review meets the few quotas of its month at once. Rows that no plan takes are never copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.operators import sampling, studies

PLANNED = ("time-proportional", "equal-per-window")
NEWEST, UNIFORM = "cursor-prefix", "uniform-random"


def quotas(pools: DataFrame, sizes: list[int]) -> DataFrame:
    """app_id, quantile, size, start, policy, quota for pools (app_id, quantile, pool_size, start of the month) larger than a size."""
    months = pools.groupBy("app_id", "quantile", "pool_size", "start").agg(F.count("*").alias("population"))
    pool = Window.partitionBy("app_id", "quantile")
    months = months.withColumn("end", F.lead("start").over(pool.orderBy("start")))
    months = months.withColumn("later", F.coalesce(F.sum("population").over(pool.orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    each = months.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).filter("size < pool_size")
    key = ["app_id", "quantile", "size", "start"]
    found = each.select(*key, F.lit(NEWEST).alias("policy"), F.greatest(F.lit(0), F.least("population", F.col("size") - F.col("later"))).cast("long").alias("quota"))
    for kind in PLANNED:
        plan = sampling.apportion(each, F.col("size"), kind, keys=("app_id", "quantile", "size"))
        found = found.unionByName(plan.select(*key, F.lit(kind).alias("policy"), "quota"))
    return found.filter("quota > 0")


def policy_draws(members: DataFrame, sizes: list[int]) -> DataFrame:
    """Draws of every plan and size from pools (app_id, quantile, pool_size, review_id, created_at): app_id, quantile, size, policy,
    review_id."""
    pools = members.withColumn("start", F.date_trunc("month", "created_at").cast("timestamp_ntz"))
    month = ["app_id", "quantile", "start"]
    rank = F.row_number().over(Window.partitionBy(*month).orderBy(F.desc("created_at"), F.desc("review_id")))
    asked = quotas(pools, sizes).groupBy(*month).agg(F.collect_list(F.struct("policy", "size", "quota")).alias("asked"))
    # no quota is above its size, so what ranks after the largest size is left where it is, before any shuffle
    first = pools.select(*month, "review_id", rank.alias("rank")).filter(F.col("rank") <= max(sizes))
    placed = first.join(asked, month)
    taken = placed.select("app_id", "quantile", "review_id", F.explode(F.filter("asked", lambda q: q["quota"] >= F.col("rank"))).alias("q"))
    return taken.select("app_id", "quantile", "q.size", "q.policy", "review_id")


def whole_sweep(members: DataFrame, hits: DataFrame, regime: DataFrame, sizes: list[int], repeats: int, seed: str) -> DataFrame:
    """One row for each pool, policy, size and aspect: the plans' single draws, and uniform ones over their repeats."""
    pools = members.select("app_id", "quantile", "pool_size", "review_id")
    cell = ["app_id", "quantile", "size", "repeat", "policy", "review_id"]
    planned = policy_draws(members, sizes).withColumn("repeat", F.lit(0)).select(*cell)
    uniform = studies.draws(pools, sizes, repeats, seed).withColumn("policy", F.lit(UNIFORM)).select(*cell)
    rows = studies.measured(planned.unionByName(uniform), hits, studies.reference(pools, hits), regime, "policy")
    return studies.cells(rows, "policy")


def first_by_hash(rows: DataFrame, keys: list[str], place: Column, n: int, rank: str, parts: int = 32) -> DataFrame:
    """The n rows of each key with the smallest places, and their rank. Each of a few parts of a key is cut to n first, so no task
    sorts a whole key."""
    with_place = rows.withColumn("_place", place).withColumn("_part", F.pmod(F.xxhash64("_place"), F.lit(parts)))
    order = ["_place", "review_id"]
    own = with_place.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))).filter(F.col("_own") <= n)
    whole = own.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)
    return whole.drop("_place", "_part", "_own")


def blends(base: DataFrame, marked: DataFrame, shares: list[float], repeats: int, seed: str) -> DataFrame:
    """Samples of which shares gave way to marked reviews: app_id, quantile, source, share, repeat, size, review_id.

    base: app_id, quantile, review_id (a sample of each pool); marked: source, review_id. Of a sample of n, int(share n + 0.5) reviews
    leave in the order of their hash and as many of the source's come in; share 0 is the sample itself, once. In a repeat all samples
    get the same marked reviews, so they can be compared. A source that is too small is an error, never a smaller share.
    """
    n = base.groupBy("app_id", "quantile").agg(F.count("*").alias("size"))
    m = marked.groupBy("source").agg(F.count("*").alias("m"))
    out = F.floor(F.col("share") * F.col("size") + 0.5)
    plan = n.join(m, how="cross").withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("out", out)  # a row a pool and source
    trouble = F.when(F.col("out") >= F.col("size"), "nothing of the sample would be left").when(F.col("out") > F.col("m"), "too few marked reviews")
    plan = plan.withColumn("out", F.when(trouble.isNotNull(), F.raise_error(trouble).cast("long")).otherwise(F.col("out")))
    plan = plan.withColumn("repeat", F.explode(F.when(F.col("share") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(repeats - 1)))))
    cell = ["app_id", "quantile", "source", "share", "repeat", "size"]
    text = lambda *parts: F.md5(F.concat_ws("|", F.lit(seed), *(c.cast("string") for c in parts)))
    each = base.join(m.select("source"), how="cross").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))  # a sample is small
    leave = Window.partitionBy("app_id", "quantile", "source", "repeat").orderBy(text(F.lit("out"), F.col("source"), F.col("repeat"), F.col("review_id")), "review_id")
    stays = each.withColumn("rank", F.row_number().over(leave)).join(plan, ["app_id", "quantile", "source", "repeat"]).filter("rank > out")
    most = plan.agg(F.max("out")).first()[0] or 0
    each = marked.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    first = first_by_hash(each, ["source", "repeat"], text(F.lit("in"), F.col("source"), F.col("repeat"), F.col("review_id")), most, "rank")
    comes = first.join(plan, ["source", "repeat"]).filter("rank <= out")
    return stays.select(*cell, "review_id").unionByName(comes.select(*cell, "review_id"))


def merged_truth(members: DataFrame, hits: DataFrame, marked: DataFrame) -> DataFrame:
    """Shares in each pool of its own aspects and, at 0, of those that only a source's reviews have: app_id, quantile, source, aspect,
    reference_share."""
    own = studies.reference(members, hits)
    sources = marked.select("source").distinct()
    theirs = marked.join(hits, "review_id").select("source", "aspect").distinct()
    pools = members.select("app_id", "quantile").distinct()
    strange = pools.join(theirs, how="cross").join(own.select("app_id", "quantile", "aspect"), ["app_id", "quantile", "aspect"], "left_anti")  # pools x a source's vocabulary
    return own.join(sources, how="cross").unionByName(strange.withColumn("reference_share", F.lit(0.0)))


def mixing(members: DataFrame, base: DataFrame, marked: DataFrame, hits: DataFrame, regime: DataFrame, shares: list[float], repeats: int, seed: str) -> DataFrame:
    """app_id, quantile, source, share: repeats (draws), mean_error, max_error, shipped_rate, within_rate, over all aspects.

    Two shares that swap as many reviews have the same samples. A sum's last digits depend on its order, so means are rounded to 12
    places: equal samples have equal rows.
    """
    drawn = blends(base, marked, shares, repeats, seed)
    rows = studies.measured(drawn, hits, merged_truth(members, hits, marked), regime, "source", "share")
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return rows.groupBy("app_id", "quantile", "source", "share").agg(
        F.count_distinct("repeat").alias("repeats"), F.round(F.avg("error"), 12).alias("mean_error"), F.max("error").alias("max_error"), rate("shipped_covered").alias("shipped_rate"), rate("within_tolerance").alias("within_rate")
    )


def marked_faults(usable: DataFrame, labelled: DataFrame, windows: DataFrame) -> DataFrame:
    """source, review_id, fault: labelled reviews that are not usable, and usable labelled ones outside of their source's window, or of
    a source without one. usable: source, review_id, created_at; windows: source, start, end, both inclusive."""
    strange = labelled.join(usable, ["source", "review_id"], "left_anti").select("source", "review_id", F.lit("labelled but not usable").alias("fault"))
    held = usable.join(labelled.select("source", "review_id").distinct(), ["source", "review_id"], "left_semi").join(windows, "source", "left")
    fault = F.when(F.col("start").isNull(), "no window").when(~F.col("created_at").between(F.col("start"), F.col("end")), "outside its window")
    return strange.unionByName(held.select("source", "review_id", fault.alias("fault")).filter("fault IS NOT NULL"))


def marked_pool(usable: DataFrame, labelled: DataFrame, windows: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources whose reviews are all in order: reviews (source, review_id), and their index (source, aspect, n). Any fault refuses all."""
    first = marked_faults(usable, labelled, windows).limit(5).collect()
    if first:
        raise ValueError(f"marked pools are not in order: {[tuple(r) for r in first]}")
    pool = usable.join(labelled.select("source", "review_id").distinct(), ["source", "review_id"], "left_semi").select("source", "review_id")
    return pool, pool.join(hits, "review_id").groupBy("source", "aspect").agg(F.count_distinct("review_id").alias("n"))


def regimes(members: DataFrame, peak: float = 2 / 3) -> DataFrame:
    """The regime of each pool, all in one pass: app_id, quantile, population, peak_share, regime (spiky from ``peak``, inclusive)."""
    months = members.groupBy("app_id", "quantile", F.date_trunc("month", "created_at").alias("start")).agg(F.count("*").alias("n"))
    per = months.groupBy("app_id", "quantile").agg(F.sum("n").alias("population"), (F.max("n") / F.sum("n")).alias("peak_share"))
    return per.withColumn("regime", F.when(F.col("peak_share") >= peak, "spiky").otherwise("calm"))
