"""What a run may see and what it says of itself: scopes of experiments, surfaces, plans' totals, run ids, latencies, repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.functions import text as tx
from hearsay.functions.intervals import ratio


def for_surface(canaries: DataFrame, surface: str) -> DataFrame:
    """Canaries of a surface, and those of both."""
    return canaries.filter(F.col("surface").isin(surface, "both"))


def planned_totals(plans: DataFrame, windows: DataFrame) -> DataFrame:
    """plan_id, planned: a cursor prefix plans its target, every other kind the sum of its windows' quotas. plans: plan_id, kind, target."""
    sums = windows.groupBy("plan_id").agg(F.sum("quota").cast("long").alias("quotas"))
    planned = F.when(F.col("kind") == "cursor-prefix", F.col("target").cast("long")).otherwise(F.coalesce("quotas", F.lit(0)))
    return plans.join(sums, "plan_id", "left").select("plan_id", planned.alias("planned"))


def aspect_yield(sizes: DataFrame, mentions: DataFrame) -> DataFrame:
    """app_id, sample_size, aspect_bearing, share (null without reviews), phrase. sizes: app_id, sample_size; mentions: app_id, review_id."""
    n = mentions.groupBy("app_id").agg(F.count_distinct("review_id").alias("aspect_bearing"))
    rows = sizes.join(n, "app_id", "left").fillna(0, ["aspect_bearing"])
    share = ratio(F.col("aspect_bearing"), F.col("sample_size"))
    whole = lambda c: F.format_number(F.col(c), 0)
    says = F.concat(whole("aspect_bearing"), F.lit(" of "), whole("sample_size"), F.lit(" analyzed reviews carry at least one aspect"))
    return rows.select("app_id", "sample_size", "aspect_bearing", share.alias("share"), F.when(F.col("sample_size") == 0, "no reviews analyzed").otherwise(says).alias("phrase"))


def probe_summary(records: DataFrame, *keys: str) -> DataFrame:
    """Per keys: sent, ok, first_bad (the first call that was not answered 200), p50, p95, most of elapsed_ms by nearest rank.

    records: keys, call_id, status, elapsed_ms. Calls are counted by latency first, so ranks are sums over distinct latencies.
    """
    sums = records.groupBy(*keys).agg(
        F.count("*").alias("sent"), F.count_if(F.col("status") == 200).alias("ok"), F.min(F.when(~F.col("status").eqNullSafe(F.lit(200)), F.col("call_id"))).alias("first_bad"), F.count("elapsed_ms").alias("timed"),
    )
    values = records.filter("elapsed_ms IS NOT NULL").groupBy(*keys, "elapsed_ms").agg(F.count("*").alias("n"))
    upto = values.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys).orderBy("elapsed_ms"))).join(sums.select(*keys, "timed"), list(keys))
    at = lambda f: F.min(F.when(F.col("upto") > F.bround(F.lit(f) * (F.col("timed") - 1)), F.col("elapsed_ms")))
    ranks = upto.groupBy(*keys).agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("elapsed_ms").alias("most"))
    return sums.drop("timed").join(ranks, list(keys), "left")


def run_id(prefix: Column, started: Column, tail: Column | None = None) -> Column:
    """<prefix>-<UTC second>-<8 hex>: sorts by time; the tail (random unless given) tells runs of one second apart."""
    tail = F.replace(F.uuid(), F.lit("-"), F.lit("")) if tail is None else F.sha2(tail.cast("string"), 256)
    return F.concat_ws("-", prefix, F.date_format(started, "yyyyMMdd'T'HHmmss'Z'"), F.substring(tail, 1, 8))


def validated(rows: DataFrame, allowed: dict[str, tuple[str, ...]], times: tuple[str, ...] = ()) -> DataFrame:
    """rows whose enums are known and whose times are there; the first other row fails the job as it is read."""
    out = {c: F.when(F.col(c).isin(*vs), F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"no such {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("null")))).cast("string")) for c, vs in allowed.items()}
    out |= {c: F.when(F.try_to_timestamp(F.col(c).cast("string")).isNotNull(), F.try_to_timestamp(F.col(c).cast("string"))).otherwise(F.raise_error(F.concat(F.lit(f"no time {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("null")))).cast("timestamp")) for c in times}
    return rows.withColumns(out)


def manifest_repairs(manifests: DataFrame) -> DataFrame:
    """labeled, repairs, rate over run manifests (manifest: JSON); what a manifest lacks counts as 0, one that is broken fails."""
    read = F.from_json("manifest", "reviews struct<labeled:bigint,evidence_repairs:bigint>", {"mode": "FAILFAST"})
    sums = manifests.select(read.alias("m")).agg(F.coalesce(F.sum("m.reviews.labeled"), F.lit(0)).alias("labeled"), F.coalesce(F.sum("m.reviews.evidence_repairs"), F.lit(0)).alias("repairs"))
    return sums.withColumn("rate", ratio(F.col("repairs"), F.col("labeled")))


def scope_faults(records: DataFrame, stored: DataFrame, scope: str) -> DataFrame:
    """review_id, fault: records of a scope that are not stored, or whose text is another one.

    A sample (review_id, text_sha256) pins the stored text's digest; gold (review_id, text) has the text itself, up to outer blanks.
    """
    both = records.alias("r").join(stored.select("review_id", F.col("text").alias("_stored")), "review_id", "left")
    same = F.col("text_sha256") == F.sha2("_stored", 256) if scope == "sample" else tx.strip(F.col("text")) == tx.strip(F.col("_stored"))
    fault = F.when(F.col("_stored").isNull(), "not stored").when(~F.coalesce(same, F.lit(False)), "another text")
    return both.select("review_id", fault.alias("fault")).filter("fault IS NOT NULL")


def scope_reviews(records: DataFrame, stored: DataFrame, scope: str, excluded: tuple[int, ...] = ()) -> DataFrame:
    """Stored rows of a scope's records in scope; any fault of these refuses the whole. Gold leaves out excluded apps."""
    asked = records if scope == "sample" or not excluded else records.filter(~F.col("app_id").isin(*excluded))
    first = scope_faults(asked, stored, scope).orderBy("review_id").limit(5).collect()
    if first:
        raise ValueError(f"the {scope} is not what is stored: {[tuple(r) for r in first]}")
    return stored.join(asked.select("review_id").distinct(), "review_id", "left_semi")


def eligible_draw(reviews: DataFrame, excluded: DataFrame, n: int, seed: str, least: int, most: int, language: str = "english") -> DataFrame:
    """n reviews an app by a seeded hash among eligible ones: of the language, least to most characters once stripped, not excluded.

    Each of 256 parts of an app keeps its n smallest hashes before these meet, so an app's pool is never sorted in one task.
    """
    size = F.char_length(tx.strip(F.col("text")))
    pool = reviews.filter((F.col("language") == language) & size.between(least, most)).join(excluded.select("review_id").distinct(), "review_id", "left_anti")
    place = F.md5(F.concat_ws("|", F.lit(seed), "review_id"))
    parts = pool.select("app_id", "review_id", place.alias("place"), F.pmod(F.xxhash64("review_id"), F.lit(256)).alias("part"))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("place", "review_id"))
    some = parts.withColumn("k", rank("app_id", "part")).filter(F.col("k") <= n)  # at most 256 n rows an app go on
    return some.withColumn("rank", rank("app_id")).filter(F.col("rank") <= n).select("app_id", "review_id", F.col("rank").cast("long").alias("rank"))
