"""Queries of stored reviews, envelopes, runs and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearsay import views
from hearsay.operators import lookups, series
from hearsay.operators.aggregates import on_version
from hearsay.plans.journals import BASE as LEDGER
from hearsay.plans.marts import MINT_SQL, SCOPE, mint
from hearsay.plans.series import MONTHS_SQL
from hearsay.views import ENVELOPES_SQL, MENTIONS_SQL, REVIEWS_SQL


def _r():
    return F.col("review_id").cast("long")


def excluded_counts(spark, sf_dir):
    return lookups.without(views.reviews(spark, sf_dir), "app_id", [7, 3]).groupBy("app_id").agg(F.count("*").alias("n"))


def served_usable(spark, sf_dir):
    text = F.when(_r() % 9 == 4, F.lit("  \n")).otherwise(F.col("review_id"))
    return views.reviews(spark, sf_dir).groupBy("app_id").agg(F.count_if(lookups.served_usable(F.col("language"), text)).alias("usable"), F.count("*").alias("n"))


def asked_reviews(spark, sf_dir):
    asked = views.reviews(spark, sf_dir).filter(_r() % 8 == 1).select(F.when(_r() % 16 == 1, F.concat(F.lit("x"), "review_id")).otherwise(F.col("review_id")).alias("review_id"))
    return lookups.looked_up(views.reviews(spark, sf_dir), "review_id", asked).select("review_id", "app_id")


def whole_fixture(spark, sf_dir):
    asked = views.reviews(spark, sf_dir).filter(_r() % 25 == 7).select("review_id")
    return lookups.all_or_none(views.envelopes(spark, sf_dir).select("review_id", "origin"), "review_id", asked)


def envelopes_with_runs(spark, sf_dir):
    e = views.envelopes(spark, sf_dir).withColumn("run_id", _r() % 4)
    runs = spark.range(4).select(F.col("id").alias("run_id"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("code_version"))
    out = lookups.with_runs(e, views.mentions(spark, sf_dir), runs)
    return out.groupBy("code_version").agg(F.count("*").alias("n"), F.sum(F.size("mentions")).alias("mentions"), F.min(F.array_join(F.transform("mentions", lambda m: m["position"].cast("string")), ",")).alias("least"))


def latest_reports(spark, sf_dir):
    reports = views.reviews(spark, sf_dir).filter(_r() % 20 == 3).select("app_id", "created_at", F.col("review_id").alias("run_id"))
    runs = views.reviews(spark, sf_dir).select(F.col("review_id").alias("run_id"), F.concat(F.lit("c"), (_r() % 5).cast("string")).alias("code_version"))
    return lookups.latest_reports(reports, runs)


def envelope_sizes(spark, sf_dir):
    return lookups.mentions_per_envelope(views.envelopes(spark, sf_dir).filter(on_version()), views.mentions(spark, sf_dir).filter("slot = 'candidate'"))


def gold_backfill(spark, sf_dir):
    r = views.reviews(spark, sf_dir)
    gold = r.filter(_r() % 10 == 3).select(F.when(_r() % 70 == 3, F.concat(F.lit("x"), "review_id")).otherwise(F.col("review_id")).alias("review_id"))
    return lookups.backfilled(gold, r.filter(_r() % 3 == 0), r.select("review_id", "app_id")).groupBy("app_id", "in_corpus").agg(F.count("*").alias("n"))


def spent_since(spark, sf_dir):
    from hearsay.plans.journals import ledger

    return lookups.since(ledger(spark, sf_dir).withColumnRenamed("user_id", "visitor"), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))


def walk_places(spark, sf_dir):
    place = lookups.window_place(F.col("created_at"), F.lit("1995-01-01 00:00:00").cast("timestamp_ntz"), F.lit("1996-03-01 00:00:00").cast("timestamp_ntz"))
    return views.reviews(spark, sf_dir).groupBy("app_id", place.alias("place")).agg(F.count("*").alias("n"))


def paths(spark, sf_dir):
    w = views.reviews(spark, sf_dir).groupBy("app_id", F.year("created_at").alias("y")).agg(F.count_if(_r() % 40 == 5).alias("primary_strangers"), (F.min(_r()) % 2 == 0).alias("fallback_ok"))
    return lookups.paths_taken(w)


def skipped_pages(spark, sf_dir):
    return lookups.skip_pages(series.histogram(views.reviews(spark, sf_dir)), F.lit("1995-06-15 00:00:00").cast("timestamp_ntz"), 31, 7)


def reservations(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.sum(lookups.reservation(F.col("text"), F.lit(800), F.lit(100), F.lit(400))).cast("long").alias("reserved"))


def published_hits(spark, sf_dir):
    hits = views.table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 14).alias("app_id"))
    return lookups.decorated(hits, mint(spark, sf_dir).filter("band = 'headline'")).groupBy("app_id", "published").agg(F.count("*").alias("n"))


def window_populations(spark, sf_dir):
    m = series.histogram(views.reviews(spark, sf_dir))
    return lookups.window_populations(m.filter("month(start) % 5 = 2").select("app_id", "start"), m)


def merged_candidates(spark, sf_dir):
    m = mint(spark, sf_dir).filter("slot = 'candidate'").withColumn("aspect", F.concat(F.substring("aspect", 1, 5), F.when(F.col("n_reviews") % 2 == 0, "_").otherwise(" "), F.substring("aspect", 7, 1)))
    return lookups.merged_candidates(m.groupBy("app_id", "aspect").agg(F.sum("n_reviews").alias("n_reviews")))


BASE = f"WITH {REVIEWS_SQL}, {ENVELOPES_SQL}, {MENTIONS_SQL}, {MONTHS_SQL}, mint AS ({MINT_SQL}), v AS (SELECT *, CAST(review_id AS BIGINT) AS r FROM reviews)"
QUERIES = {
    "excluded_counts": excluded_counts, "served_usable": served_usable, "asked_reviews": asked_reviews, "whole_fixture": whole_fixture, "envelopes_with_runs": envelopes_with_runs, "latest_reports": latest_reports,
    "envelope_sizes": envelope_sizes, "gold_backfill": gold_backfill, "spent_since": spent_since, "walk_places": walk_places, "paths_taken": paths, "skipped_pages": skipped_pages, "call_reservations": reservations,
    "published_hits": published_hits, "window_populations": window_populations, "merged_candidates": merged_candidates,
}
ORACLE = {
    "excluded_counts": f"{BASE} SELECT app_id, count(*) AS n FROM v WHERE app_id NOT IN (3, 7) GROUP BY 1",
    "served_usable": f"{BASE} SELECT app_id, count(*) FILTER (language = 'english' AND r % 9 <> 4) AS usable, count(*) AS n FROM v GROUP BY 1",
    "asked_reviews": f"{BASE} SELECT review_id, app_id FROM v WHERE r % 8 = 1 AND r % 16 <> 1",
    "whole_fixture": f"{BASE} SELECT review_id, origin FROM envelopes WHERE CAST(review_id AS BIGINT) % 25 = 7",
    "envelopes_with_runs": f"""{BASE}, m AS (SELECT review_id, count(*) AS n, string_agg(position::VARCHAR, ',' ORDER BY position) AS p FROM mentions GROUP BY 1) SELECT 'v' || (CAST(e.review_id AS BIGINT) % 4) AS code_version, count(*) AS n, sum(coalesce(m.n, 0))::BIGINT AS mentions, min(coalesce(p, '')) AS least FROM envelopes e LEFT JOIN m USING (review_id) GROUP BY 1""",
    "latest_reports": f"{BASE} SELECT app_id, created_at, review_id AS run_id, 'c' || (r % 5) AS code_version FROM v WHERE r % 20 = 3 QUALIFY row_number() OVER (PARTITION BY app_id ORDER BY created_at DESC, review_id DESC) = 1",
    "envelope_sizes": f"{BASE}, c AS (SELECT review_id, count(*) AS n FROM mentions WHERE slot = 'candidate' GROUP BY 1) SELECT coalesce(n, 0) AS n_mentions, count(*) AS envelopes FROM envelopes LEFT JOIN c USING (review_id) WHERE {SCOPE} GROUP BY 1",
    "gold_backfill": f"{BASE} SELECT CASE WHEN r % 70 <> 3 THEN app_id END AS app_id, r % 70 <> 3 AS in_corpus, count(*) AS n FROM v WHERE r % 10 = 3 AND (r % 3 <> 0 OR r % 70 = 3) GROUP BY 1, 2",
    "walk_places": f"{BASE} SELECT app_id, CASE WHEN created_at > TIMESTAMP '1996-03-01' THEN 'above' WHEN created_at < TIMESTAMP '1995-01-01' THEN 'below' ELSE 'in' END AS place, count(*) AS n FROM v GROUP BY 1, 2",
    "paths_taken": f"{BASE}, w AS (SELECT app_id, year(created_at) AS y, count(*) FILTER (r % 40 = 5) AS s, min(r) % 2 = 0 AS f FROM v GROUP BY 1, 2) SELECT app_id, count(*) FILTER (s = 0) AS \"primary\", count(*) FILTER (s > 0 AND f) AS fallback, count(*) FILTER (s > 0 AND NOT f) AS skipped FROM w GROUP BY 1",
    "skipped_pages": f"{BASE} SELECT app_id, ceil(coalesce(sum(up + down) FILTER (start + INTERVAL 31 DAY > TIMESTAMP '1995-06-15'), 0) / 7.0)::BIGINT AS pages FROM months GROUP BY 1",
    "call_reservations": "SELECT lang, sum(ceil(length(text) / 3.0) * 100 + 800 * 400)::BIGINT AS reserved FROM documents GROUP BY 1",
    "published_hits": f"{BASE} SELECT c_custkey % 14 AS app_id, c_custkey % 14 IN (SELECT app_id FROM mint WHERE band = 'headline') AS published, count(*) AS n FROM customer GROUP BY 1, 2",
    "window_populations": f"{BASE} SELECT app_id, start, (up + down)::BIGINT AS population FROM months WHERE month(start) % 5 = 2",
    "merged_candidates": f"""{BASE}, c AS (SELECT app_id, substr(aspect, 1, 5) || CASE WHEN n_reviews % 2 = 0 THEN '_' ELSE ' ' END || substr(aspect, 7, 1) AS a, sum(n_reviews) AS n FROM mint WHERE slot = 'candidate' GROUP BY 1, 2) SELECT app_id, replace(a, '_', ' ') AS aspect, sum(n)::BIGINT AS n_reviews, count(*) AS of FROM c GROUP BY 1, 2""",
    "spent_since": f"{LEDGER} SELECT count(*) AS n, count(DISTINCT user_id) AS visitors, coalesce(sum(cost), 0)::BIGINT AS cost FROM ledger JOIN (SELECT event_id, user_id FROM events) u USING (event_id) WHERE created_at >= TIMESTAMP '2024-01-20'",
}
