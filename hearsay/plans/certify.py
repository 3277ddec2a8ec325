"""Queries that certify labels: pinned mentions of one review in four as the reference, and two runs that read them."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearsay import views
from hearsay.operators import certify
from hearsay.operators.aggregates import on_version
from hearsay.plans.marts import SCOPE
from hearsay.plans.selection import failures
from hearsay.views import ENVELOPES_SQL, MENTIONS_SQL, REVIEWS_SQL

OPTIONS = {"resamples": 200, "buckets": 256, "seed": "b"}


def _gold(spark, sf_dir):
    m = views.mentions(spark, sf_dir).filter(F.col("review_id").cast("long") % 4 == 0)
    r = F.col("review_id").cast("long") + F.length("aspect")
    one = m.groupBy("review_id", "aspect", "slot").agg(F.min("sentiment").alias("sentiment"))
    return one.filter(r % 8 != 0)


def _predicted(spark, sf_dir, k=7):
    m = views.mentions(spark, sf_dir).filter(F.col("review_id").cast("long") % 4 == 0)
    r = F.col("review_id").cast("long") + F.length("aspect")
    one = m.groupBy("review_id", "aspect", "slot").agg(F.min("sentiment").alias("sentiment"))
    return one.filter(r % k != 0).withColumn("sentiment", F.when(r % 5 == 0, "mixed").otherwise(F.col("sentiment")))


def _asked(spark, sf_dir):
    return views.reviews(spark, sf_dir).filter(F.col("review_id").cast("long") % 4 == 0).select("review_id", "app_id", (F.col("review_id").cast("long") % 3).alias("stratum"))


def _accounts(spark, sf_dir):
    """Reviews of app 3 are out of scope."""
    return certify.accounts(_asked(spark, sf_dir).filter("app_id <> 3"), views.envelopes(spark, sf_dir).filter(on_version()), failures(spark, sf_dir))


def _tallies(spark, sf_dir, k=7):
    rows = _accounts(spark, sf_dir).filter("outcome <> 'unaccounted'")
    read = rows.filter("outcome = 'read'").select("review_id")
    return certify.tallies(rows, _gold(spark, sf_dir).join(rows.select("review_id"), "review_id"), _predicted(spark, sf_dir, k).join(read, "review_id"))


def pool_accounts(spark, sf_dir):
    return _accounts(spark, sf_dir).groupBy("app_id", "outcome").agg(F.count("*").alias("n"))


def review_tallies(spark, sf_dir):
    return _tallies(spark, sf_dir).select("review_id", "tp", "fp", "fn", "sentiment_correct", "gold_zero", "pred_zero", "parse_failed", "n_candidates")


def full_scorecard(spark, sf_dir):
    return certify.score(_tallies(spark, sf_dir), "stratum").drop("reviews")


def certification(spark, sf_dir):
    return certify.metrics(_tallies(spark, sf_dir), **OPTIONS)


def holdout(spark, sf_dir):
    return certify.holdout_metrics(_tallies(spark, sf_dir))


def _runs(spark, sf_dir):
    """Four runs of the same reviews: which labels they lack differs."""
    out = None
    for name, k in (("a", 7), ("b", 6), ("c", 5), ("d", 11)):
        one = _tallies(spark, sf_dir, k).withColumn("run", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def _f1():
    return certify.f1_of(F.col("tp"), F.col("fp"), F.col("fn"))


def paired(spark, sf_dir):
    return certify.paired_bootstrap(_runs(spark, sf_dir), _f1(), ["tp", "fp", "fn"], "a", "b", **OPTIONS)


def interaction(spark, sf_dir):
    return certify.interaction_bootstrap(_runs(spark, sf_dir), _f1(), ["tp", "fp", "fn"], ("a", "b", "c", "d"), **OPTIONS)


def bake_off(spark, sf_dir):
    return certify.ranked(certify.score(_runs(spark, sf_dir), "run").select("run", "tp", "fp", "fn", "f1", "sentiment_accuracy"), "f1")


def bootstrap_f1(spark, sf_dir):
    return certify.bootstrap(_tallies(spark, sf_dir), _f1(), ["tp", "fp", "fn"], resamples=400, buckets=512)


def aspect_agreement(spark, sf_dir):
    read = _accounts(spark, sf_dir).filter("outcome = 'read'").select("review_id")
    g = _gold(spark, sf_dir).filter("slot = 'pinned'").join(read, "review_id").select("review_id", "aspect", F.lit(1).alias("g"))
    p = _predicted(spark, sf_dir).filter("slot = 'pinned'").join(read, "review_id").select("review_id", "aspect", F.lit(1).alias("p"))
    one = lambda c: c.cast("long")
    pairs = g.join(p, ["review_id", "aspect"], "full_outer").select("review_id", "aspect", one(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), one(F.col("g").isNull()).alias("fp"), one(F.col("p").isNull()).alias("fn"))
    return certify.aspect_agreement(pairs, 4, **OPTIONS)


def _verdicts(spark, sf_dir):
    """Verdicts on mentions with evidence: whether aspect and sentiment are backed, by shares of their numbers."""
    m = views.mentions(spark, sf_dir).filter("evidence IS NOT NULL AND slot = 'pinned'")
    r = F.col("review_id").cast("long") + F.col("position")
    say = lambda k, j: F.when(r % k == 1, "no").when(r % j == 2, "undecided").otherwise("yes")
    return m.select(F.concat_ws(":", "review_id", "position").alias("item"), "review_id", say(9, 17).alias("aspect_supported"), say(7, 19).alias("sentiment_supported"))


def audit(spark, sf_dir):
    return certify.audit_reading(_verdicts(spark, sf_dir), ["aspect_supported", "sentiment_supported"])


def audit_faults(spark, sf_dir):
    """Verdicts with lines lost, doubled, strange and about others on purpose, against their sample."""
    v = _verdicts(spark, sf_dir).select("item", "review_id").distinct()
    r = F.col("review_id").cast("long")
    sample = v.filter(r % 101 != 5).select("item", "review_id")
    given = v.filter(r % 103 != 7).withColumn("review_id", F.when(r % 107 == 9, F.lit("0")).otherwise(F.col("review_id")))
    given = given.unionByName(given.filter(r % 109 == 11))
    return certify.audit_coverage(given, sample).groupBy("fault").agg(F.count("*").alias("n"))


def run_comparison(spark, sf_dir):
    m = lambda k: certify.score(_tallies(spark, sf_dir, k), "stratum").select(F.concat(F.lit("f1/"), F.col("stratum").cast("string")).alias("metric"), F.round("f1", 9).alias("value"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    return certify.run_differences(m(7), m(6))


def _pairs_sql(k):
    return f"""p{k} AS (SELECT * FROM (SELECT review_id, aspect, slot, CASE WHEN (CAST(review_id AS BIGINT) + length(aspect)) % 5 = 0 THEN 'mixed' ELSE s END AS sentiment FROM one) WHERE (CAST(review_id AS BIGINT) + length(aspect)) % {k} <> 0 AND review_id IN (SELECT review_id FROM acc WHERE outcome = 'read')),
b{k} AS (SELECT review_id, aspect, g.sentiment AS g, p.sentiment AS p FROM (SELECT * FROM gold WHERE slot = 'pinned') g FULL JOIN (SELECT * FROM p{k} WHERE slot = 'pinned') p USING (review_id, aspect)),
t{k} AS (SELECT review_id, app_id, stratum, 1 AS reviews, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(sc, 0) AS sentiment_correct, (coalesce(tp, 0) + coalesce(fn, 0) = 0)::BIGINT AS gold_zero,
  (outcome = 'read' AND coalesce(tp, 0) + coalesce(fp, 0) + coalesce(nc, 0) = 0)::BIGINT AS pred_zero, (outcome = 'failed')::BIGINT AS parse_failed, coalesce(nc, 0) AS n_candidates, coalesce(gc, 0) AS gold_candidates,
  (outcome = 'read' AND coalesce(tp, 0) + coalesce(fp, 0) = 0)::BIGINT AS quiet
  FROM (SELECT * FROM acc WHERE outcome <> 'unaccounted') a LEFT JOIN (SELECT review_id, count(*) FILTER (g IS NOT NULL AND p IS NOT NULL) AS tp, count(*) FILTER (g IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn, count(*) FILTER (g = p) AS sc FROM b{k} GROUP BY 1) USING (review_id)
  LEFT JOIN (SELECT review_id, count(DISTINCT aspect) AS nc FROM p{k} WHERE slot = 'candidate' GROUP BY 1) USING (review_id) LEFT JOIN (SELECT review_id, count(DISTINCT aspect) AS gc FROM gold WHERE slot = 'candidate' GROUP BY 1) USING (review_id))"""


BASE = f"""WITH {REVIEWS_SQL}, {ENVELOPES_SQL}, {MENTIONS_SQL}, acc AS (SELECT review_id, app_id, CAST(review_id AS BIGINT) % 3 AS stratum, CASE WHEN review_id IN (SELECT review_id FROM envelopes WHERE {SCOPE}) THEN 'read' WHEN CAST(review_id AS BIGINT) % 13 = 0 THEN 'failed' ELSE 'unaccounted' END AS outcome
  FROM reviews WHERE CAST(review_id AS BIGINT) % 4 = 0 AND app_id <> 3),
one AS (SELECT review_id, aspect, slot, min(sentiment) AS s FROM mentions WHERE CAST(review_id AS BIGINT) % 4 = 0 GROUP BY 1, 2, 3),
gold AS (SELECT review_id, aspect, slot, s AS sentiment FROM one WHERE (CAST(review_id AS BIGINT) + length(aspect)) % 8 <> 0 AND review_id IN (SELECT review_id FROM acc WHERE outcome <> 'unaccounted')), {_pairs_sql(7)}"""
F1 = "CASE WHEN sum(tp) + sum(fp) = 0 OR sum(tp) + sum(fn) = 0 THEN NULL ELSE 2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) END"


def _weights(resamples, buckets):
    """Poisson(1) weights of buckets by the same hash."""
    cumulative, term, cases = 0.0, 0.36787944117144233, []
    for k in range(1, 8):
        cumulative += term
        cases.append((k, cumulative))
        term /= k
    cases = " ".join(f"WHEN u >= {c!r} THEN {k}" for k, c in reversed(cases))
    return f"""w AS (SELECT resample, bucket, CASE {cases} ELSE 0 END AS w FROM (SELECT r.i AS resample, b.i AS bucket, ('0x' || substr(md5('b|' || r.i || '|' || b.i), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM range({resamples}) r(i), range({buckets}) b(i)))"""


def _bucket(buckets):
    return f"('0x' || substr(md5('b|' || review_id), 1, 8))::BIGINT % {buckets}"


def _weighted(expression):
    for c in ("tp", "fp", "fn", "sentiment_correct", "quiet", "reviews"):
        expression = expression.replace(f"sum({c})", f"sum(w * {c})")
    return expression


def _drawn(rows, buckets, key, expression):
    """key, resample, v."""
    return f"SELECT {key}, resample, {_weighted(expression)} AS v FROM (SELECT *, {_bucket(buckets)} AS bucket FROM ({rows})) JOIN w USING (bucket) GROUP BY ALL"


BOUNDS = "list_sort(list(v) FILTER (v IS NOT NULL))"
LOW = f"CASE WHEN count(v) >= 0.99 * count(*) THEN {BOUNDS}[round_even(0.025 * (count(v) - 1), 0)::INT + 1] END"
HIGH = LOW.replace("0.025", "0.975")
RUNS = "SELECT 'a' AS run, * FROM t7 UNION ALL SELECT 'b', * FROM t6 UNION ALL SELECT 'c', * FROM t5 UNION ALL SELECT 'd', * FROM t11"
FOUR = f"{BASE}, {_pairs_sql(6)}, {_pairs_sql(5)}, {_pairs_sql(11)}, {_weights(200, 256)}, runs AS ({RUNS})"
STATS = {
    "precision": "sum(tp) / nullif(sum(tp) + sum(fp), 0)::DOUBLE", "recall": "sum(tp) / nullif(sum(tp) + sum(fn), 0)::DOUBLE", "f1": F1, "sentiment_accuracy": "sum(sentiment_correct) / nullif(sum(tp), 0)::DOUBLE",
}
PLAIN = {"zero_share_pred": "sum(pred_zero) / sum(reviews)::DOUBLE", "candidate_emission_rate": "sum(n_candidates) / nullif(sum(tp) + sum(fp) + sum(n_candidates), 0)::DOUBLE", "parse_failure_rate": "sum(parse_failed) / sum(reviews)::DOUBLE"}
SLICES = (("zero_mention", "gold_zero = 1", "zero_mention_agreement", "sum(quiet) / nullif(sum(reviews), 0)::DOUBLE"), ("multi_mention", "tp + fn >= 2", "f1_multi_mention", F1), ("candidate_emitting", "gold_candidates > 0", "f1_candidate_emitting", F1))


def _with_bounds(name, rows, expression, buckets=256):
    return f"SELECT '{name}' AS metric, (SELECT {expression} FROM ({rows})) AS value, {LOW} AS low, {HIGH} AS high FROM ({_drawn(rows, buckets, '1 AS one', expression)})"


WILSON = "(a + z*z/(2*n)) / (1 + z*z/n) {0} z * sqrt(a*(1-a)/n + z*z/(4.0*n*n)) / (1 + z*z/n)"
QUERIES = {
    "pool_accounts": pool_accounts, "review_tallies": review_tallies, "full_scorecard": full_scorecard, "certification_metrics": certification, "holdout_metrics": holdout,
    "paired_bootstrap": paired, "interaction_bootstrap": interaction, "bake_off": bake_off, "bootstrap_f1": bootstrap_f1, "aspect_agreement": aspect_agreement, "audit_reading": audit,
    "audit_faults": audit_faults, "run_comparison": run_comparison,
}
ORACLE = {
    "pool_accounts": f"{BASE} SELECT app_id, outcome, count(*) AS n FROM acc GROUP BY 1, 2",
    "review_tallies": f"{BASE} SELECT review_id, tp, fp, fn, sentiment_correct, gold_zero, pred_zero, parse_failed, n_candidates FROM t7",
    "full_scorecard": f"""{BASE} SELECT stratum, {", ".join(f"sum({c})::BIGINT AS {c}" for c in certify.SUMS[1:])}, {", ".join(f"{e} AS {n}" for n, e in STATS.items())}, sum(gold_zero) / sum(reviews)::DOUBLE AS zero_share_gold, {", ".join(f"{e} AS {n}" for n, e in PLAIN.items())} FROM t7 GROUP BY 1""",
    "certification_metrics": f"{BASE}, {_weights(200, 256)} " + " UNION ALL ".join(
        [_with_bounds(n, "SELECT * FROM t7", e) for n, e in STATS.items()] + [f"SELECT '{n}' AS metric, {e} AS value, NULL::DOUBLE AS low, NULL::DOUBLE AS high FROM t7" for n, e in PLAIN.items()]
        + [f"SELECT 'n_{n}', count(*)::DOUBLE, NULL, NULL FROM t7 WHERE {c}" for n, c, _, _ in SLICES] + [f"SELECT * FROM ({_with_bounds(s, f'SELECT * FROM t7 WHERE {c}', e)}) WHERE value IS NOT NULL" for _, c, s, e in SLICES]
    ),
    "holdout_metrics": f"""{BASE}, h AS (SELECT *, parse_failed = 0 AND fp = 0 AND fn = 0 AS same, parse_failed = 0 AND fp = 0 AND fn = 0 AND sentiment_correct = tp AS agrees FROM t7), k AS (SELECT unnest(['', '/' || stratum]) AS slice, agrees FROM h),
        c AS (SELECT slice, count(*) AS n, count(*) FILTER (agrees) / count(*)::DOUBLE AS a, 1.959963984540054 AS z FROM k GROUP BY 1)
        SELECT 'n' || slice AS metric, n::DOUBLE AS value, NULL::DOUBLE AS low, NULL::DOUBLE AS high FROM c UNION ALL SELECT 'agreement' || slice, a, greatest(0, {WILSON.format("-")}), least(1, {WILSON.format("+")}) FROM c
        UNION ALL SELECT 'aspect_set_match', count(*) FILTER (same) / count(*)::DOUBLE, NULL, NULL FROM h UNION ALL SELECT 'n_aspect_set_match', count(*) FILTER (same), NULL, NULL FROM h
        UNION ALL SELECT * FROM (SELECT 'sentiment_given_set_match', count(*) FILTER (agrees) / nullif(count(*) FILTER (same), 0)::DOUBLE AS v, NULL, NULL FROM h) WHERE v IS NOT NULL UNION ALL SELECT 'parse_failure_rate', sum(parse_failed) / count(*)::DOUBLE, NULL, NULL FROM h""",
    "paired_bootstrap": f"""{FOUR}, d AS ({_drawn("SELECT * FROM runs WHERE run IN ('a', 'b')", 256, "run", F1)}), x AS (SELECT resample, max(v) FILTER (run = 'a') - max(v) FILTER (run = 'b') AS v FROM d GROUP BY 1),
        y AS (SELECT (SELECT {F1} FROM t7) - (SELECT {F1} FROM t6) AS difference, count(v) AS n, {LOW} AS low, {HIGH} AS high FROM x) SELECT *, CASE WHEN low > 0 THEN 'ahead' WHEN high < 0 THEN 'behind' ELSE 'indistinguishable' END AS read FROM y""",
    "interaction_bootstrap": f"""{FOUR}, d AS ({_drawn("SELECT * FROM runs", 256, "run", F1)}), x AS (SELECT resample, CASE WHEN count(v) = 4 THEN sum(CASE WHEN run IN ('a', 'd') THEN v ELSE -v END) END AS v FROM d GROUP BY 1)
        SELECT (SELECT {F1} FROM t7) - (SELECT {F1} FROM t6) - (SELECT {F1} FROM t5) + (SELECT {F1} FROM t11) AS interaction, count(v) AS n, {LOW} AS low, {HIGH} AS high FROM x""",
    "bake_off": f"""{FOUR}, s AS (SELECT run, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, {F1} AS f1, {STATS["sentiment_accuracy"]} AS sentiment_accuracy FROM runs GROUP BY 1) SELECT *, row_number() OVER (ORDER BY f1 DESC NULLS LAST, run)::INT AS rank FROM s""",
    "bootstrap_f1": f"""{BASE}, {_weights(400, 512)} SELECT (SELECT {F1} FROM t7) AS value, count(v) AS n, {LOW} AS low, {HIGH} AS high FROM ({_drawn("SELECT * FROM t7", 512, "1 AS one", F1)})""",
    "aspect_agreement": f"""{BASE}, {_weights(200, 256)}, q AS (SELECT review_id, aspect, (g IS NOT NULL AND p IS NOT NULL)::INT AS tp, (g IS NULL)::INT AS fp, (p IS NULL)::INT AS fn FROM b7 WHERE review_id IN (SELECT review_id FROM acc WHERE outcome = 'read')),
        n AS (SELECT aspect, sum(tp + fn)::BIGINT AS reference_n, 2.0 * sum(tp) / nullif(sum(2 * tp + fp + fn), 0) AS f1 FROM q GROUP BY 1 HAVING sum(tp + fn) >= 4), d AS ({_drawn("SELECT * FROM q", 256, "aspect", "2.0 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0)")})
        SELECT aspect, reference_n, f1, low, high FROM n JOIN (SELECT aspect, {LOW} AS low, {HIGH} AS high FROM d GROUP BY 1) USING (aspect)""",
    "audit_reading": f"""WITH {MENTIONS_SQL}, v AS (SELECT CAST(review_id AS BIGINT) + position AS r FROM mentions WHERE evidence IS NOT NULL AND slot = 'pinned'), f AS (SELECT CASE WHEN r % 9 = 1 THEN 'no' WHEN r % 17 <> 2 THEN 'yes' END AS a, CASE WHEN r % 7 = 1 THEN 'no' WHEN r % 19 <> 2 THEN 'yes' END AS s FROM v),
        l AS (SELECT 'aspect_supported' AS field, a AS v FROM f UNION ALL SELECT 'sentiment_supported', s FROM f UNION ALL SELECT 'any', CASE WHEN a = 'no' OR s = 'no' THEN 'no' WHEN a IS NOT NULL AND s IS NOT NULL THEN 'yes' END FROM f),
        c AS (SELECT field, count(v) AS decided, count(*) FILTER (v = 'no') AS no, count(*) FILTER (v IS NULL) AS undecided, count(v) AS n, count(*) FILTER (v = 'no') / count(v)::DOUBLE AS a, 1.959963984540054 AS z FROM l GROUP BY 1)
        SELECT field, decided, no, undecided, a AS rate, greatest(0, {WILSON.format("-")}) AS low, least(1, {WILSON.format("+")}) AS high FROM c""",
    "audit_faults": f"""WITH {MENTIONS_SQL}, v AS (SELECT DISTINCT CAST(review_id AS BIGINT) AS r, review_id || ':' || position AS item FROM mentions WHERE evidence IS NOT NULL AND slot = 'pinned'),
        f AS (SELECT CASE WHEN r % 103 = 7 THEN CASE WHEN r % 101 <> 5 THEN 'missing' END WHEN r % 101 = 5 THEN 'strange' WHEN CASE WHEN r % 107 = 9 THEN 0 ELSE r END % 109 = 11 THEN 'twice' WHEN r % 107 = 9 THEN 'another review' END AS fault FROM v) SELECT fault, count(*) AS n FROM f WHERE fault IS NOT NULL GROUP BY 1""",
    "run_comparison": f"""{FOUR}, a AS (SELECT 'f1/' || stratum AS metric, round({F1}, 9) AS v FROM t7 GROUP BY stratum), b AS (SELECT 'f1/' || stratum AS metric, round({F1}, 9) AS v FROM t6 GROUP BY stratum)
        SELECT metric, 'first' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT metric, 'second' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
}
