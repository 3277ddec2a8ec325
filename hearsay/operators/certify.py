"""Certification of labels: tallies of each review, scorecards with bootstrap intervals, slices, agreement, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.functions.intervals import ratio, wilson

#: Sums that statistics are made of.
SUMS = ("reviews", "tp", "fp", "fn", "sentiment_correct", "gold_zero", "pred_zero", "parse_failed", "n_candidates")

def accounts(asked: DataFrame, envelopes: DataFrame, failures: DataFrame) -> DataFrame:
    """asked (review_id, ...) with outcome: read (an envelope is there), failed (a durable mark is), or unaccounted."""
    e = envelopes.select("review_id").distinct().withColumn("_read", F.lit(True))
    f = failures.select("review_id").distinct().withColumn("_failed", F.lit(True))
    outcome = F.when(F.col("_read").isNotNull(), "read").when(F.col("_failed").isNotNull(), "failed").otherwise("unaccounted")
    return asked.join(e, "review_id", "left").join(f, "review_id", "left").withColumn("outcome", outcome).drop("_read", "_failed")


def demand_none(rows: DataFrame, bad: Column, message: str) -> DataFrame:
    """rows, which fail with the message at the first one that is bad."""
    return rows.withColumn("_ok", F.when(bad, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True))).filter("_ok").drop("_ok")


def tallies(accounted: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row for each review of accounted (review_id, outcome): pinned pairs in both, in one, sentiments right, and flags.

    gold and predicted: review_id, aspect, slot, sentiment. A failed review has no predictions; it is no considered zero.
    Reviews that nothing accounts for must be settled before.
    """
    pinned = lambda d, c: d.filter("slot = 'pinned'").groupBy("review_id", "aspect").agg(F.collect_set("sentiment").alias(c))
    pairs = pinned(gold, "g").join(pinned(predicted, "p"), ["review_id", "aspect"], "full_outer")
    both = F.col("g").isNotNull() & F.col("p").isNotNull()
    sums = pairs.groupBy("review_id").agg(
        F.count_if(both).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"),
        F.count_if(both & (F.col("g") == F.col("p")) & (F.size("p") == 1)).alias("sentiment_correct"),
    )
    open_ = lambda d, c: d.filter("slot = 'candidate'").groupBy("review_id").agg(F.count_distinct("aspect").alias(c))
    rows = accounted.join(sums, "review_id", "left").join(open_(predicted, "n_candidates"), "review_id", "left").join(open_(gold, "gold_candidates"), "review_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    failed = F.col("outcome") == "failed"
    return rows.select(
        *accounted.columns, F.lit(1).cast("long").alias("reviews"), *[zero(c).alias(c) for c in ("tp", "fp", "fn", "sentiment_correct", "n_candidates", "gold_candidates")],
        ((zero("tp") + zero("fn")) == 0).cast("long").alias("gold_zero"), (~failed & ((zero("tp") + zero("fp") + zero("n_candidates")) == 0)).cast("long").alias("pred_zero"),
        failed.cast("long").alias("parse_failed"),
    )


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    """Null if precision or recall is undefined, 0 if both are 0."""
    return F.when((tp + fp == 0) | (tp + fn == 0), None).otherwise(2.0 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)))


def statistics() -> dict[str, Column]:
    """Statistics as expressions over summed tallies."""
    tp, fp, fn, n = (F.col(c) for c in ("tp", "fp", "fn", "reviews"))
    return {
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": f1_of(tp, fp, fn), "sentiment_accuracy": ratio(F.col("sentiment_correct"), tp),
        "zero_share_gold": ratio(F.col("gold_zero"), n), "zero_share_pred": ratio(F.col("pred_zero"), n),
        "candidate_emission_rate": ratio(F.col("n_candidates"), tp + fp + F.col("n_candidates")), "parse_failure_rate": ratio(F.col("parse_failed"), n),
    }


def summed(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in SUMS])


def score(rows: DataFrame, *keys: str) -> DataFrame:
    """The scorecard of tallies, overall or by keys."""
    return summed(rows, *keys).select(*keys, *SUMS, *[e.alias(name) for name, e in statistics().items()])


def resampled(rows: DataFrame, sums: list[str], keys: list[str], resamples: int, buckets: int, seed: str) -> DataFrame:
    """keys, resample and the sums of each resample.

    Reviews are summed into hash buckets first, so that the work of resampling does not grow with them; a resample weighs a
    bucket by a Poisson(1) draw from a hash of both. Any number of executors draw the same, and rows of one review that are
    in several runs get the same weights, so differences are paired.
    """
    bucket = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("review_id"))), 1, 8), 16, 10).cast("long") % buckets
    held = rows.withColumn("bucket", bucket).groupBy(*keys, "bucket").agg(*[F.sum(c).alias(c) for c in sums])
    each = held.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("resample").cast("string"), F.col("bucket").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    weight, cumulative, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 8):  # the inverse of Poisson(1)'s distribution
        cumulative += term
        weight = F.when(u >= cumulative, k).otherwise(weight)
        term /= k
    each = each.withColumn("w", weight)
    return each.groupBy(*keys, "resample").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in sums])


def percentile_bounds(values: DataFrame, keys: list[str], value: str = "value", most_undefined: float = 0.01) -> DataFrame:
    """keys, n (defined resamples), low, high: by rank round(q (n - 1)), half to even. More undefined ones than the bound: no
    interval."""
    got = values.groupBy(*keys).agg(F.count("*").alias("of"), F.array_sort(F.collect_list(value)).alias("v"))  # resamples values a key
    at = lambda q: F.get(F.col("v"), F.bround(q * (F.size("v") - 1), 0).cast("int"))
    sound = F.size("v") >= (1 - most_undefined) * F.col("of")
    return got.select(*keys, F.size("v").cast("long").alias("n"), F.when(sound, at(F.lit(0.025))).alias("low"), F.when(sound, at(F.lit(0.975))).alias("high"))


def bootstrap(rows: DataFrame, statistic: Column, sums: list[str], keys: list[str] | None = None, resamples: int = 400, buckets: int = 512, seed: str = "b") -> DataFrame:
    """keys, value, n, low, high of a statistic over summed tallies, by resampling reviews."""
    keys = keys or []
    drawn = resampled(rows, sums, keys, resamples, buckets, seed).select(*keys, statistic.alias("value"))
    value = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).select(*keys, statistic.alias("value"))
    bounds = percentile_bounds(drawn, keys)
    return value.join(bounds, keys) if keys else value.withColumn("_k", F.lit(1)).join(bounds.withColumn("_k", F.lit(1)), "_k").drop("_k")


def paired_bootstrap(runs: DataFrame, statistic: Column, sums: list[str], a: str, b: str, **options) -> DataFrame:
    """runs (run, review_id, sums...) -> difference a - b of the statistic, with an interval over shared draws, and how it reads."""
    resamples, buckets, seed = options.get("resamples", 400), options.get("buckets", 512), options.get("seed", "b")
    either = runs.filter(F.col("run").isin(a, b))
    drawn = resampled(either, sums, ["run"], resamples, buckets, seed).select("run", "resample", statistic.alias("v"))
    of = lambda run: F.max(F.when(F.col("run") == run, F.col("v")))
    differences = drawn.groupBy("resample").agg((of(a) - of(b)).alias("value"))
    point = either.groupBy("run").agg(*[F.sum(c).alias(c) for c in sums]).select("run", statistic.alias("v")).agg((of(a) - of(b)).alias("difference"))
    out = point.withColumn("_k", F.lit(1)).join(percentile_bounds(differences, []).withColumn("_k", F.lit(1)), "_k").drop("_k")
    return out.withColumn("read", F.when(F.col("low") > 0, "ahead").when(F.col("high") < 0, "behind").otherwise("indistinguishable"))


def interaction_bootstrap(runs: DataFrame, statistic: Column, sums: list[str], cells: tuple[str, str, str, str], **options) -> DataFrame:
    """Difference of differences (c0 - c1) - (c2 - c3) of four runs over shared draws."""
    resamples, buckets, seed = options.get("resamples", 400), options.get("buckets", 512), options.get("seed", "b")
    sign = F.when(F.col("run").isin(cells[0], cells[3]), 1.0).otherwise(-1.0)
    every = runs.filter(F.col("run").isin(*cells))
    drawn = resampled(every, sums, ["run"], resamples, buckets, seed).select("resample", (sign * statistic).alias("v"))
    values = drawn.groupBy("resample").agg(F.when(F.count("v") == 4, F.sum("v")).alias("value"))
    point = every.groupBy("run").agg(*[F.sum(c).alias(c) for c in sums]).agg(F.sum(sign * statistic).alias("interaction"))
    return point.withColumn("_k", F.lit(1)).join(percentile_bounds(values, []).withColumn("_k", F.lit(1)), "_k").drop("_k")


class Slice:
    """Reviews of one kind: a condition on tallies, and the statistic that is read on them."""

    def __init__(self, name: str, member: Column, stat_name: str, statistic: Column):
        self.name, self.member, self.stat_name, self.statistic = name, member, stat_name, statistic


def slices() -> list[Slice]:
    quiet = ratio(F.col("quiet"), F.col("reviews"))
    f1 = f1_of(F.col("tp"), F.col("fp"), F.col("fn"))
    return [
        Slice("zero_mention", F.col("gold_zero") == 1, "zero_mention_agreement", quiet),
        Slice("multi_mention", F.col("tp") + F.col("fn") >= 2, "f1_multi_mention", f1),
        Slice("candidate_emitting", F.col("gold_candidates") > 0, "f1_candidate_emitting", f1),
    ]


def metrics(rows: DataFrame, **options) -> DataFrame:
    """metric, value, low, high: four statistics with intervals, three without, and the slices' numbers and statistics. A
    slice's number is always there, its statistic only where it is defined."""
    known = statistics()
    rows = rows.withColumn("quiet", ((F.col("parse_failed") == 0) & (F.col("tp") + F.col("fp") == 0)).cast("long"))
    sums = [*SUMS, "quiet"]
    draws = resampled(rows, sums, [], options.get("resamples", 400), options.get("buckets", 512), options.get("seed", "b"))
    named = lambda d, names: d.select(F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), known[n].alias("value")) for n in names))))
    four = ["precision", "recall", "f1", "sentiment_accuracy"]
    whole = rows.agg(*[F.sum(c).alias(c) for c in sums])
    out = named(whole, four).join(percentile_bounds(named(draws, four), ["metric"]), "metric").select("metric", "value", "low", "high")
    plain = named(whole, ["zero_share_pred", "candidate_emission_rate", "parse_failure_rate"])
    none = F.lit(None).cast("double")
    out = out.unionByName(plain.select("metric", "value", none.alias("low"), none.alias("high")))
    for s in slices():
        own = rows.filter(s.member)
        out = out.unionByName(own.agg(F.count("*").cast("double").alias("value")).select(F.lit(f"n_{s.name}").alias("metric"), "value", none.alias("low"), none.alias("high")))
        out = out.unionByName(bootstrap(own, s.statistic, sums, **options).filter("value IS NOT NULL").select(F.lit(s.stat_name).alias("metric"), "value", "low", "high"))
    return out


def aspect_agreement(pairs: DataFrame, floor: int = 30, **options) -> DataFrame:
    """Per aspect with at least ``floor`` mentions in the reference: aspect, reference_n, f1, low, high, by number, then name.

    pairs: review_id, aspect, tp, fp, fn; only reviews that name the aspect on some side are resampled.
    """
    n = pairs.groupBy("aspect").agg((F.sum("tp") + F.sum("fn")).cast("long").alias("reference_n")).filter(F.col("reference_n") >= floor)
    f1 = 2.0 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))
    got = bootstrap(pairs.join(n.select("aspect"), "aspect"), f1, ["tp", "fp", "fn"], ["aspect"], **options)
    return got.join(n, "aspect").select("aspect", "reference_n", F.col("value").alias("f1"), "low", "high").orderBy(F.desc("reference_n"), "aspect")


def holdout_metrics(rows: DataFrame) -> DataFrame:
    """metric, value, low, high of tallies with a stratum: strict agreement overall and by stratum with Wilson bounds, set
    match, sentiment given a set match (no row without one), parse failures."""
    same = (F.col("parse_failed") == 0) & (F.col("fp") == 0) & (F.col("fn") == 0)
    rows = rows.withColumn("same", same).withColumn("agrees", same & (F.col("sentiment_correct") == F.col("tp")))
    keyed = rows.withColumn("slice", F.explode(F.array(F.lit(""), F.concat(F.lit("/"), F.col("stratum").cast("string")))))
    counts = keyed.groupBy("slice").agg(F.count("*").alias("n"), F.count_if("agrees").alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    none = F.lit(None).cast("double")
    lines = counts.select(F.inline(F.array(
        F.struct(F.concat(F.lit("n"), "slice").alias("metric"), F.col("n").cast("double").alias("value"), none.alias("low"), none.alias("high")),
        F.struct(F.concat(F.lit("agreement"), "slice").alias("metric"), ratio(F.col("k"), F.col("n")).alias("value"), low.alias("low"), high.alias("high")),
    )))
    total = rows.agg(F.count("*").alias("n"), F.count_if("same").alias("m"), F.count_if("agrees").alias("k"), F.sum("parse_failed").alias("bad"))
    one = lambda name, value: F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"), none.alias("low"), none.alias("high"))
    parts = total.select(F.inline(F.array(
        one("aspect_set_match", ratio(F.col("m"), F.col("n"))), one("n_aspect_set_match", F.col("m")),
        one("sentiment_given_set_match", ratio(F.col("k"), F.col("m"))), one("parse_failure_rate", ratio(F.col("bad"), F.col("n"))),
    )))
    return lines.unionByName(parts.filter("value IS NOT NULL"))


def audit_reading(verdicts: DataFrame, fields: list[str]) -> DataFrame:
    """Per field of verdicts (yes, no or undecided): field, decided, no, undecided, rate of no with Wilson bounds; and the
    claims with any no among those where every field is decided or some is a no."""
    decided = [F.col(f).isin("yes", "no") for f in fields]
    any_no, all_decided = F.lit(False), F.lit(True)
    for f, d in zip(fields, decided, strict=True):
        any_no, all_decided = any_no | (F.col(f) == "no"), all_decided & d
    rows = [F.struct(F.lit(f).alias("field"), F.when(F.col(f).isin("yes", "no"), F.col(f)).alias("v")) for f in fields]
    rows.append(F.struct(F.lit("any").alias("field"), F.when(any_no, "no").when(all_decided, "yes").alias("v")))
    long = verdicts.select(F.inline(F.array(*rows)))
    out = long.groupBy("field").agg(F.count("v").alias("decided"), F.count_if(F.col("v") == "no").alias("no"), F.count_if(F.col("v").isNull()).alias("undecided"))
    low, high = wilson(F.col("no"), F.col("decided"))
    return out.select("*", ratio(F.col("no"), F.col("decided")).alias("rate"), low.alias("low"), high.alias("high"))


def audit_coverage(verdicts: DataFrame, sample: DataFrame, key: str = "item") -> DataFrame:
    """Faults of verdicts against the sample they were made for: missing, strange, twice, or about another review. One row
    for each: key, fault. Empty when all is in order."""
    v = verdicts.groupBy(key).agg(F.count("*").alias("times"), F.min("review_id").alias("theirs"))
    both = sample.select(key, F.col("review_id").alias("ours")).join(v, key, "full_outer")
    fault = F.when(F.col("times").isNull(), "missing").when(F.col("ours").isNull(), "strange").when(F.col("times") > 1, "twice").when(F.col("ours") != F.col("theirs"), "another review")
    return both.select(key, fault.alias("fault")).filter("fault IS NOT NULL")


def run_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Metrics (metric, value, low, high) that two runs do not share exactly: metric, side."""
    only = lambda x, y, side: x.exceptAll(y).select("metric", F.lit(side).alias("side"))
    return only(a, b, "first").unionByName(only(b, a, "second"))


def ranked(scores: DataFrame, by: str) -> DataFrame:
    """Candidates by a score, undefined ones last, with their rank."""
    order = Window.orderBy(F.col(by).desc_nulls_last(), "run")  # one row a candidate
    return scores.withColumn("rank", F.row_number().over(order))
