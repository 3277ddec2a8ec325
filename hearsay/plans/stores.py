"""Queries over tables that were changed all at once, and over fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearsay import views
from hearsay.sources import store as st
from hearsay.streaming import runs
from hearsay.views import ENVELOPES_SQL, MENTIONS_SQL, REVIEWS_SQL

KEYS = {"mentions": ["review_id", "position", "copy"], "snapshots": ["app_id", "aspect"]}


def renamed(aspect):
    """Candidates of makers 1 fold into those of maker 2, which are there; those of maker 5 get a name that is new."""
    return F.when(aspect.startswith("Brand#1"), F.concat(F.lit("Brand#2"), F.substring(aspect, 8, 1))).when(aspect.startswith("Brand#5"), F.concat(F.lit("Brand five "), F.substring(aspect, 8, 1)))


def repaired_snapshots(spark, sf_dir):
    """Mentions and snapshots of their counts, patched together: renamed mentions, and counts moved to where the names went."""
    m = views.mentions(spark, sf_dir).filter("slot = 'candidate'").select("review_id", "position", "aspect", "sentiment")
    m = m.withColumn("copy", F.expr("row_number() OVER (PARTITION BY review_id, position ORDER BY aspect, sentiment)"))
    app = views.reviews(spark, sf_dir).select("review_id", "app_id")
    s = m.join(app, "review_id").groupBy("app_id", "aspect").agg(F.count("*").alias("n"), F.count_if(F.col("sentiment") == "negative").alias("negative"))
    store = st.Store(spark, runs.folder(spark, "store"))
    store.commit(0, {"mentions": (m, KEYS["mentions"], None), "snapshots": (s, KEYS["snapshots"], None)})
    m, s = store.read("mentions", 1), store.read("snapshots", 1)
    rename = m.withColumn("after_aspect", renamed(F.col("aspect"))).filter("after_aspect IS NOT NULL").select("review_id", "position", "copy", F.col("aspect").alias("before_aspect"), "after_aspect")
    moved = s.withColumn("to", renamed(F.col("aspect"))).filter("to IS NOT NULL")
    gone = moved.select("app_id", "aspect", "n", "negative", F.lit(0).alias("add_n"), F.lit(0).alias("add_negative"), F.lit(True).alias("drop"))
    into = moved.groupBy("app_id", F.col("to").alias("aspect")).agg(F.sum("n").alias("add_n"), F.sum("negative").alias("add_negative"))
    grown = s.join(into, ["app_id", "aspect"]).select("app_id", "aspect", "n", "negative", "add_n", "add_negative", F.lit(False).alias("drop"))
    patch = gone.unionByName(grown).select(
        "app_id", "aspect", F.col("n").alias("before_n"), F.col("negative").alias("before_negative"), (F.col("n") + F.col("add_n")).alias("after_n"),
        (F.col("negative") + F.col("add_negative")).alias("after_negative"), "drop",
    )
    done = st.repair(store, {"mentions": (rename, ["aspect"]), "snapshots": (patch, ["n", "negative"])})
    fresh = into.join(store.read("snapshots", done).select("app_id", "aspect"), ["app_id", "aspect"], "left_anti")
    st.append_together(store, {"snapshots": fresh.select("app_id", "aspect", F.col("add_n").alias("n"), F.col("add_negative").alias("negative"))})
    counted = store.read("mentions").join(app, "review_id").groupBy("app_id", "aspect").agg(F.count("*").alias("mentions"))
    return store.read("snapshots").join(counted, ["app_id", "aspect"], "full")


def fixture_round_trip(spark, sf_dir):
    """Reviews and envelopes as a fixture, read back after its digests held: what is in them by app."""
    folder = runs.folder(spark, "fixture")
    tables = {"reviews": views.reviews(spark, sf_dir), "envelopes": views.envelopes(spark, sf_dir)}
    st.export_fixture(tables, folder, {"reviews": ["review_id"], "envelopes": ["review_id"]}, rows_per_file=1000)
    got = st.load_fixture(spark, folder)
    r = got["reviews"].join(got["envelopes"].drop("app_id"), "review_id")
    return r.groupBy("app_id", "language", "origin", "ontology_version").agg(F.count("*").alias("n"), F.count_if("voted_up").alias("up"), F.min("created_at").alias("oldest"), F.max("review_id").alias("last_id"))


QUERIES = {"repaired_snapshots": repaired_snapshots, "fixture_round_trip": fixture_round_trip}
ORACLE = {
    "repaired_snapshots": f"""WITH {REVIEWS_SQL}, {MENTIONS_SQL}, m AS (SELECT app_id, sentiment, CASE WHEN aspect LIKE 'Brand#1%' THEN 'Brand#2' || aspect[8] WHEN aspect LIKE 'Brand#5%' THEN 'Brand five ' || aspect[8] ELSE aspect END AS aspect FROM mentions JOIN reviews USING (review_id) WHERE slot = 'candidate')
      SELECT app_id, aspect, count(*) AS n, count(*) FILTER (sentiment = 'negative') AS negative, count(*) AS mentions FROM m GROUP BY 1, 2""",
    "fixture_round_trip": f"""WITH {REVIEWS_SQL}, {ENVELOPES_SQL} SELECT r.app_id, language, origin, ontology_version, count(*) AS n, count(*) FILTER (voted_up) AS up, min(created_at) AS oldest, max(review_id) AS last_id FROM reviews r JOIN envelopes USING (review_id) GROUP BY 1, 2, 3, 4""",
}
