"""Queries that compare two label sets: pinned mentions against a perturbed copy of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearsay import views
from hearsay.operators import evaluation
from hearsay.views import MENTIONS_SQL, SENTIMENTS


def _sets(spark, sf_dir):
    m = views.mentions(spark, sf_dir).filter("slot = 'pinned'")
    one = m.groupBy("review_id", "aspect").agg(F.min("sentiment").alias("sentiment"), F.min("position").alias("position"))
    r = F.col("review_id").cast("long") + F.length("aspect")
    gold = one.filter(r % 8 != 0).select("review_id", "aspect", "sentiment")
    predicted = one.filter(r % 7 != 0).select("review_id", "aspect", F.when(r % 5 == 0, "mixed").otherwise(F.col("sentiment")).alias("sentiment"))
    return gold, predicted


def _pairs(spark, sf_dir):
    return evaluation.paired(*_sets(spark, sf_dir))


def scorecard(spark, sf_dir):
    return evaluation.scorecard(_pairs(spark, sf_dir))


def per_aspect(spark, sf_dir):
    return evaluation.scorecard(_pairs(spark, sf_dir), "aspect")


def confusion(spark, sf_dir):
    return evaluation.confusion(_pairs(spark, sf_dir), SENTIMENTS)


def agreement(spark, sf_dir):
    strata = _pairs(spark, sf_dir).withColumn("stratum", F.col("review_id").cast("long") % 3)
    return evaluation.agreement(strata, ["stratum"])


def evidence_scan(spark, sf_dir):
    """Evidence must be a part of the text it is taken from. A review's text is its evidence here, without one piece in seven,
    so that there is something to find."""
    m = views.mentions(spark, sf_dir).filter("evidence IS NOT NULL")
    pieces = F.array_sort(F.collect_list(F.struct("position", "evidence")))
    texts = m.filter("position % 7 <> 3").groupBy("review_id").agg(F.array_join(F.transform(pieces, lambda x: x["evidence"]), " / ").alias("text"))
    return evaluation.evidence_violations(m, texts, "aspect")


def word_labels(spark, sf_dir):
    """Labels against a text rule: quality predicted from text length, by language."""
    d = views.table(spark, sf_dir, "documents").join(views.table(spark, sf_dir, "labels"), "doc_id")
    p = (F.char_length("text") >= 200).cast("int")
    rows = d.select("lang", F.col("quality").cast("int").alias("y"), p.alias("p"))
    tallies = rows.select("lang", (F.col("y") * F.col("p")).alias("tp"), ((1 - F.col("y")) * F.col("p")).alias("fp"), (F.col("y") * (1 - F.col("p"))).alias("fn"), F.lit(0).alias("same_sentiment"))
    return evaluation.scorecard(tallies, "lang").drop("same_sentiment", "sentiment_accuracy")


PAIRS = f"""WITH {MENTIONS_SQL}, one AS (SELECT review_id, aspect, min(sentiment) AS sentiment, CAST(review_id AS BIGINT) + length(aspect) AS r FROM mentions WHERE slot = 'pinned' GROUP BY 1, 2),
gold AS (SELECT review_id, aspect, sentiment AS g FROM one WHERE r % 8 <> 0), pred AS (SELECT review_id, aspect, CASE WHEN r % 5 = 0 THEN 'mixed' ELSE sentiment END AS p FROM one WHERE r % 7 <> 0),
pairs AS (SELECT review_id, aspect, g, p, (g IS NOT NULL AND p IS NOT NULL)::INT AS tp, (g IS NULL)::INT AS fp, (p IS NULL)::INT AS fn, coalesce(g = p, false)::INT AS same_sentiment FROM gold FULL JOIN pred USING (review_id, aspect))"""
SCORE = """sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(same_sentiment)::BIGINT AS same_sentiment, sum(tp) / nullif(sum(tp + fp), 0)::DOUBLE AS precision,
sum(tp) / nullif(sum(tp + fn), 0)::DOUBLE AS recall, 2 * sum(tp) / nullif(sum(2 * tp + fp + fn), 0)::DOUBLE AS f1, sum(same_sentiment) / nullif(sum(tp), 0)::DOUBLE AS sentiment_accuracy"""

QUERIES = {
    "scorecard": scorecard, "per_aspect_f1": per_aspect, "sentiment_confusion": confusion, "holdout_agreement": agreement, 
    "evidence_scan": evidence_scan, "label_rule_by_language": word_labels,
}
ORACLE = {
    "scorecard": f"{PAIRS} SELECT {SCORE} FROM pairs",
    "per_aspect_f1": f"{PAIRS} SELECT aspect, {SCORE} FROM pairs GROUP BY 1",
    "sentiment_confusion": f"""{PAIRS} SELECT g AS gold, {", ".join(f"count(*) FILTER (p = '{v}') AS {v}" for v in SENTIMENTS)} FROM pairs WHERE tp = 1 GROUP BY 1""",
    "holdout_agreement": f"""{PAIRS}, per AS (SELECT CAST(review_id AS BIGINT) % 3 AS stratum, review_id, sum(fp + fn) = 0 AS agrees FROM pairs GROUP BY 1, 2),
        s AS (SELECT stratum, count(*) AS n, count(*) FILTER (agrees) AS k, count(*) FILTER (agrees) / count(*)::DOUBLE AS a, 1.959963984540054 AS z FROM per GROUP BY 1)
        SELECT stratum, n, k, a AS agreement, greatest(0, (a + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(a*(1-a)/n + z*z/(4.0*n*n)) / (1 + z*z/n)) AS low,
        least(1, (a + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(a*(1-a)/n + z*z/(4.0*n*n)) / (1 + z*z/n)) AS high FROM s""",
    "evidence_scan": f"""WITH {MENTIONS_SQL}, m AS (SELECT * FROM mentions WHERE evidence IS NOT NULL), t AS (SELECT review_id, string_agg(evidence, ' / ' ORDER BY position, evidence) AS text FROM m WHERE position % 7 <> 3 GROUP BY 1)
        SELECT aspect, count(*) AS n, count(*) FILTER (text IS NULL OR NOT contains(text, evidence)) AS violations FROM m LEFT JOIN t USING (review_id) GROUP BY 1""",
    "label_rule_by_language": """WITH r AS (SELECT lang, quality AS y, (length(text) >= 200)::INT AS p FROM documents JOIN labels USING (doc_id)), t AS (SELECT lang, y * p AS tp, (1 - y) * p AS fp, y * (1 - p) AS fn FROM r)
        SELECT lang, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tp) / nullif(sum(tp + fp), 0)::DOUBLE AS precision, sum(tp) / nullif(sum(tp + fn), 0)::DOUBLE AS recall,
        CASE WHEN sum(tp + fp) = 0 OR sum(tp + fn) = 0 THEN NULL ELSE 2 * sum(tp) / sum(2 * tp + fp + fn)::DOUBLE END AS f1 FROM t GROUP BY 1""",
}
