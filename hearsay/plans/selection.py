"""Queries over stored labels: what is owed, what is new, what is newest."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearsay import views
from hearsay.operators import selection
from hearsay.operators.aggregates import on_version
from hearsay.plans.marts import SCOPE
from hearsay.views import ENVELOPES_SQL, MENTIONS_SQL, REVIEWS_SQL


def failures(spark, sf_dir):
    """Durable failure marks: one review in thirteen."""
    return views.reviews(spark, sf_dir).filter(F.col("review_id").cast("long") % 13 == 0).select("review_id")


def members(spark, sf_dir):
    """A run's sample: one review in three."""
    return views.reviews(spark, sf_dir).filter(F.col("review_id").cast("long") % 3 == 0).select("review_id", "app_id", "created_at", "voted_up")


FAILURES_SQL = "failures AS (SELECT review_id FROM reviews WHERE CAST(review_id AS BIGINT) % 13 = 0)"
MEMBERS_SQL = "members AS (SELECT review_id, app_id, created_at, voted_up FROM reviews WHERE CAST(review_id AS BIGINT) % 3 = 0)"
BASE = f"WITH {REVIEWS_SQL}, {ENVELOPES_SQL}, {MENTIONS_SQL}, {FAILURES_SQL}, {MEMBERS_SQL}"
ANTI = f"review_id NOT IN (SELECT review_id FROM envelopes WHERE {SCOPE}) AND review_id NOT IN (SELECT review_id FROM failures)"


def unlabeled(spark, sf_dir):
    owed = selection.unlabeled(views.reviews(spark, sf_dir), views.envelopes(spark, sf_dir), failures(spark, sf_dir))
    return owed.select("review_id", "app_id")


def members_unlabeled(spark, sf_dir):
    owed = selection.members_unlabeled(members(spark, sf_dir), views.envelopes(spark, sf_dir), failures(spark, sf_dir))
    return owed.select("review_id", "app_id")


def member_mentions(spark, sf_dir):
    """Mentions of a run's members under the version triple, counted by aspect and sentiment."""
    scope = views.envelopes(spark, sf_dir).filter(on_version()).select("review_id", "app_id")
    scope = scope.join(members(spark, sf_dir).select("review_id"), "review_id")
    return views.mentions(spark, sf_dir).join(scope, "review_id").groupBy("app_id", "slot", "aspect", "sentiment").agg(F.count("*").alias("n"))


def member_counts(spark, sf_dir):
    """Envelopes of a run's members per app, and how many of them have mentions and evidence."""
    scope = views.envelopes(spark, sf_dir).filter(on_version()).select("review_id", "app_id").join(members(spark, sf_dir).select("review_id"), "review_id")
    per = views.mentions(spark, sf_dir).groupBy("review_id").agg(F.count("*").alias("n"), F.count("evidence").alias("e"))
    out = scope.join(per, "review_id", "left").groupBy("app_id")
    return out.agg(F.count("*").alias("n_envelopes"), F.count("n").alias("n_with_mentions"), F.coalesce(F.sum("e"), F.lit(0)).alias("n_evidence"))


def new_reviews(spark, sf_dir):
    """Idempotent ingest: arriving reviews that a store of four in five lacks."""
    every = views.reviews(spark, sf_dir)
    stored = every.filter(F.col("review_id").cast("long") % 5 != 0)
    return selection.new_rows(stored, every, "review_id").groupBy("app_id").agg(F.count("*").alias("n_inserted"))


def archive_conflicts(spark, sf_dir):
    """First write wins: keys whose arriving body differs from the stored one."""
    d = views.table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("string").alias("key"), F.sha2("text", 256).alias("body"))
    arriving = d.withColumn("body", F.when(F.col("key").cast("long") % 7 == 0, F.sha2("body", 256)).otherwise(F.col("body")))
    return selection.conflicts(d, arriving, "key", "body")


def newest_reviews(spark, sf_dir):
    r = views.reviews(spark, sf_dir)
    return selection.newest_per_key(r, "app_id", F.desc("created_at"), F.desc("review_id")).select("app_id", "review_id", "created_at")


def top_aspects(spark, sf_dir):
    """The five aspects of each app with most distinct reviews, ties by name."""
    from hearsay.plans.marts import mint

    rows = selection.top_per_key(mint(spark, sf_dir).filter("slot = 'pinned'"), ["app_id"], 5, F.desc("n_reviews"), F.col("aspect"))
    return rows.select("app_id", "rank", "aspect", "n_reviews")


def label_batches(spark, sf_dir):
    """Reviews still owed, in batches of ten per app, as calls would be made."""
    rows = selection.batches(unlabeled(spark, sf_dir), 10, "app_id", "review_id")
    return rows.groupBy("app_id", "batch").agg(F.count("*").alias("n"), F.min("review_id").alias("first_id"), F.max("review_id").alias("last_id"))


MINT_TOP = f"""{BASE}, scope AS (SELECT review_id, app_id FROM envelopes WHERE {SCOPE}),
c AS (SELECT app_id, aspect, count(DISTINCT review_id) AS n_reviews FROM mentions JOIN scope USING (review_id) WHERE slot = 'pinned' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY n_reviews DESC, aspect) AS rank FROM c)
SELECT app_id, CAST(rank AS INT) AS rank, aspect, n_reviews FROM r WHERE rank <= 5"""

QUERIES = {
    "unlabeled_under": unlabeled, "members_unlabeled_under": members_unlabeled, "member_mentions": member_mentions, "member_counts": member_counts,
    "ingest_new": new_reviews, "archive_conflicts": archive_conflicts, "newest_per_app": newest_reviews, "top_aspects": top_aspects, "label_batches": label_batches,
}
ORACLE = {
    "unlabeled_under": f"{BASE} SELECT review_id, app_id FROM reviews WHERE {ANTI}",
    "members_unlabeled_under": f"{BASE} SELECT review_id, app_id FROM members WHERE {ANTI}",
    "member_mentions": f"""{BASE} SELECT e.app_id, m.slot, m.aspect, m.sentiment, count(*) AS n FROM mentions m JOIN envelopes e USING (review_id)
        WHERE {SCOPE} AND review_id IN (SELECT review_id FROM members) GROUP BY 1, 2, 3, 4""",
    "member_counts": f"""{BASE}, per AS (SELECT review_id, count(*) AS n, count(evidence) AS e FROM mentions GROUP BY 1)
        SELECT app_id, count(*) AS n_envelopes, count(n) AS n_with_mentions, coalesce(sum(e), 0)::BIGINT AS n_evidence
        FROM (SELECT review_id, app_id FROM envelopes WHERE {SCOPE} AND review_id IN (SELECT review_id FROM members)) s LEFT JOIN per USING (review_id) GROUP BY 1""",
    "ingest_new": f"{BASE} SELECT app_id, count(*) AS n_inserted FROM reviews WHERE CAST(review_id AS BIGINT) % 5 = 0 GROUP BY 1",
    "archive_conflicts": """SELECT CAST(doc_id AS VARCHAR) AS key, sha256(text) AS stored_body, sha256(sha256(text)) AS arriving_body
        FROM documents WHERE doc_id % 7 = 0""",
    "newest_per_app": f"""{BASE} SELECT app_id, review_id, created_at FROM
        (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY created_at DESC, review_id DESC) AS rn FROM reviews) WHERE rn = 1""",
    "top_aspects": MINT_TOP,
    "label_batches": f"""{BASE}, owed AS (SELECT review_id, app_id, (row_number() OVER (PARTITION BY app_id ORDER BY review_id) - 1) // 10 AS batch FROM reviews WHERE {ANTI})
        SELECT app_id, batch, count(*) AS n, min(review_id) AS first_id, max(review_id) AS last_id FROM owed GROUP BY 1, 2""",
}
