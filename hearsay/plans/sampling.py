"""Queries that plan, draw and measure samples."""

from __future__ import annotations

from hearsay import views
from hearsay.operators import sampling, series
from hearsay.operators.aggregates import on_version
from hearsay.plans.marts import SCOPE
from hearsay.plans.series import MONTHS_SQL
from hearsay.views import ENVELOPES_SQL, MENTIONS_SQL, REVIEWS_SQL

#: Reviews of each app that a plan asks for; and when the last window closes.
ASKED, CLOSING = 300, "2003-01-01 00:00:00"


def _plan(spark, sf_dir, kind="time-proportional"):
    return sampling.apportion(sampling.plan_windows(series.histogram(views.reviews(spark, sf_dir)), CLOSING), ASKED, kind)


def plan(spark, sf_dir):
    return _plan(spark, sf_dir)


def plan_equal(spark, sf_dir):
    return _plan(spark, sf_dir, "equal-per-window")


def draw(spark, sf_dir):
    return sampling.windowed_draw(views.reviews(spark, sf_dir), _plan(spark, sf_dir)).select("app_id", "review_id", "created_at")


def prefix_draw(spark, sf_dir):
    return sampling.newest(views.reviews(spark, sf_dir), ASKED).select("app_id", "review_id")


def hashed_draw(spark, sf_dir):
    return sampling.hashed_draw(views.reviews(spark, sf_dir), ASKED, "hearsay").select("app_id", "review_id")


def measured(spark, sf_dir):
    """Share of each pinned aspect in a windowed draw against all survey reviews, with the signed error."""
    scope = views.envelopes(spark, sf_dir).filter(on_version()).select("review_id", "app_id")
    mentions = views.mentions(spark, sf_dir)
    truth = sampling.shares(scope, mentions).withColumnRenamed("share", "reference_share").drop("k", "n")
    drawn = sampling.windowed_draw(views.reviews(spark, sf_dir), _plan(spark, sf_dir)).select("review_id").join(scope, "review_id")
    from pyspark.sql import functions as F

    found = sampling.shares(drawn, mentions).select("app_id", "aspect", F.col("share").alias("s"))
    out = truth.join(found, ["app_id", "aspect"], "left")
    share = F.coalesce("s", F.lit(0.0))
    return out.select("app_id", "aspect", "reference_share", share.alias("sample_share"), (share - F.col("reference_share")).alias("error"))


def stratified(spark, sf_dir):
    """Share of positive reviews, estimated from a windowed draw."""
    plan = _plan(spark, sf_dir)
    return sampling.stratified_interval(sampling.windowed_draw(views.reviews(spark, sf_dir), plan), plan, "voted_up")


def errors(spark, sf_dir):
    return sampling.error_summary(measured(spark, sf_dir))


BASE = f"WITH {REVIEWS_SQL}, {ENVELOPES_SQL}, {MENTIONS_SQL}, {MONTHS_SQL}"
#: Time-proportional quotas of n among windows that hold at least n never meet a population, so one pass is exact.
PLAN_SQL = f"""windows AS (SELECT app_id, start, coalesce(lead(start) OVER (PARTITION BY app_id ORDER BY start), TIMESTAMP '{CLOSING}') AS "end", (up + down)::BIGINT AS population FROM months),
w AS (SELECT *, sum(population) OVER (PARTITION BY app_id) AS total FROM windows WHERE population > 0),
i AS (SELECT *, round(population * least({ASKED}, total)::DOUBLE / total, 6) AS ideal, least({ASKED}, total) AS n FROM w),
q AS (SELECT *, floor(ideal)::BIGINT AS base, row_number() OVER (PARTITION BY app_id ORDER BY ideal - floor(ideal) DESC, start) AS rk, n - sum(floor(ideal)) OVER (PARTITION BY app_id) AS short FROM i),
plan AS (SELECT app_id, start, "end", population, (base + (rk <= short)::INT)::BIGINT AS quota FROM q)"""
DRAW_SQL = """drawn AS (SELECT * FROM (SELECT r.*, quota, row_number() OVER (PARTITION BY r.app_id, start ORDER BY created_at DESC, review_id DESC) AS rk
  FROM reviews r JOIN plan p ON p.app_id = r.app_id AND p.start = date_trunc('month', r.created_at)) WHERE rk <= quota)"""
SHARES = "SELECT s.app_id, aspect, count(DISTINCT review_id) / any_value(n)::DOUBLE AS share FROM mentions JOIN {0} s USING (review_id) JOIN (SELECT app_id, count(*) AS n FROM {0} GROUP BY 1) z ON z.app_id = s.app_id WHERE slot = 'pinned' GROUP BY 1, 2"

QUERIES = {
    "plan_time_proportional": plan, "plan_equal_per_window": plan_equal, "windowed_draw": draw, "cursor_prefix_draw": prefix_draw,
    "hashed_uniform_draw": hashed_draw, "measure_draw": measured, "stratified_interval": stratified, "draw_errors": errors,
}
ORACLE = {
    "plan_time_proportional": f"{BASE}, {PLAN_SQL} SELECT * FROM plan",
    "windowed_draw": f"{BASE}, {PLAN_SQL}, {DRAW_SQL} SELECT app_id, review_id, created_at FROM drawn",
    "cursor_prefix_draw": f"""{BASE} SELECT app_id, review_id FROM (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY created_at DESC, review_id DESC) AS rk FROM reviews) WHERE rk <= {ASKED}""",
    "hashed_uniform_draw": f"""{BASE} SELECT app_id, review_id FROM (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY md5('hearsay|' || review_id), review_id) AS rk FROM reviews) WHERE rk <= {ASKED}""",
    "measure_draw": f"""{BASE}, {PLAN_SQL}, {DRAW_SQL}, scope AS (SELECT review_id, app_id FROM envelopes WHERE {SCOPE}),
        ds AS (SELECT review_id, app_id FROM scope WHERE review_id IN (SELECT review_id FROM drawn)), t AS ({SHARES.format("scope")}), f AS ({SHARES.format("ds")})
        SELECT t.app_id, t.aspect, t.share AS reference_share, coalesce(f.share, 0) AS sample_share, coalesce(f.share, 0) - t.share AS error FROM t LEFT JOIN f USING (app_id, aspect)""",
}
ORACLE["plan_equal_per_window"] = f"""{BASE}, windows AS (SELECT app_id, start, coalesce(lead(start) OVER (PARTITION BY app_id ORDER BY start), TIMESTAMP '{CLOSING}') AS "end", (up + down)::BIGINT AS population FROM months),
    w AS (SELECT *, row_number() OVER o AS j, count(*) OVER a AS m, sum(population) OVER (o ROWS UNBOUNDED PRECEDING) - population AS below, least({ASKED}, sum(population) OVER a) AS n FROM windows WHERE population > 0 WINDOW a AS (PARTITION BY app_id), o AS (PARTITION BY app_id ORDER BY population, start)),
    l AS (SELECT app_id, max((n - below)::DOUBLE / (m - j + 1)) AS level FROM w GROUP BY 1), i AS (SELECT w.*, round(least(population, level), 6) AS ideal FROM w JOIN l USING (app_id)),
    q AS (SELECT *, floor(ideal)::BIGINT AS base, row_number() OVER (PARTITION BY app_id ORDER BY ideal - floor(ideal) DESC, start) AS rk, n - sum(floor(ideal)) OVER (PARTITION BY app_id) AS short FROM i)
    SELECT app_id, start, "end", population, (base + (rk <= short)::INT)::BIGINT AS quota FROM q"""
ORACLE["draw_errors"] = f"""WITH m AS ({ORACLE["measure_draw"]}) SELECT app_id, count(*) AS aspects, avg(abs(error)) AS mean_error, quantile_cont(abs(error), 0.5) AS p50_error,
    quantile_cont(abs(error), 0.9) AS p90_error, max(abs(error)) AS max_error FROM m GROUP BY 1"""
ORACLE["stratified_interval"] = f"""{BASE}, {PLAN_SQL}, {DRAW_SQL},
    st AS (SELECT d.app_id, date_trunc('month', d.created_at) AS start, count(*)::DOUBLE AS n, count(*) FILTER (voted_up)::DOUBLE AS k FROM drawn d GROUP BY 1, 2),
    sw AS (SELECT st.*, population, population / (sum(population) OVER (PARTITION BY st.app_id))::DOUBLE AS wt FROM st JOIN plan p ON p.app_id = st.app_id AND p.start = st.start),
    es AS (SELECT app_id, sum(n)::BIGINT AS n, sum(wt * k / n) AS estimate, sqrt(sum(wt * wt * (k / n) * (1 - k / n) / greatest(n - 1, 1) * (1 - n / population))) AS error FROM sw GROUP BY 1)
    SELECT app_id, n, estimate, greatest(0, estimate - 1.959963984540054 * error) AS low, least(1, estimate + 1.959963984540054 * error) AS high FROM es"""
