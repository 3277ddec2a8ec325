"""How well one set of labels agrees with another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.functions.intervals import ratio, wilson


def paired(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """gold and predicted (review_id, aspect, sentiment) -> per pair: whether it is in one, the other or both, and whether
    the sentiments of a pair in both agree."""
    p = predicted.select("review_id", "aspect", F.col("sentiment").alias("p"), F.lit(1).alias("in_p"))
    both = gold.select("review_id", "aspect", F.col("sentiment").alias("g"), F.lit(1).alias("in_g")).join(p, ["review_id", "aspect"], "full_outer")
    one = lambda c: F.coalesce(c, F.lit(0))
    return both.select(
        "review_id", "aspect", "g", "p", (one("in_g") * one("in_p")).alias("tp"), (one("in_p") * (1 - one("in_g"))).alias("fp"),
        (one("in_g") * (1 - one("in_p"))).alias("fn"), F.coalesce((F.col("g") == F.col("p")).cast("int"), F.lit(0)).alias("same_sentiment"),
    )


def scorecard(pairs: DataFrame, *keys: str) -> DataFrame:
    """Precision, recall, F1 and sentiment accuracy, overall or by keys; undefined stays null, F1 is 0 when both are."""
    sums = pairs.groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "same_sentiment")])
    tp = F.col("tp")
    precision, recall = ratio(tp, tp + F.col("fp")), ratio(tp, tp + F.col("fn"))
    f1 = F.when(precision.isNull() | recall.isNull(), None).when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)))
    return sums.select("*", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), ratio(F.col("same_sentiment"), tp).alias("sentiment_accuracy"))


def confusion(pairs: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """Sentiments of matched pairs: a row for each gold value, a column for each predicted one."""
    matched = pairs.filter("tp = 1").groupBy("g").pivot("p", list(values)).count()
    return matched.select(F.col("g").alias("gold"), *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


def agreement(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Share of reviews whose label sets are equal, with a 95 % interval, by keys."""
    per = pairs.groupBy(*keys, "review_id").agg((F.sum(F.col("fp") + F.col("fn")) == 0).alias("agrees"))
    out = per.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("agrees").alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return out.select("*", ratio(F.col("k"), F.col("n")).alias("agreement"), low.alias("low"), high.alias("high"))


def evidence_violations(mentions: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Per key of mentions (review_id, evidence): evidence that is no part of its review's text (review_id, text), or whose
    review has none."""
    found = mentions.join(texts.select("review_id", "text"), "review_id", "left")
    bad = F.coalesce(~F.contains("text", F.col("evidence")), F.lit(True))
    return found.groupBy(key).agg(F.count("*").alias("n"), F.count_if(bad).alias("violations"))
