"""Queries over volume histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearsay import views
from hearsay.operators import series
from hearsay.views import REVIEWS_SQL


def _months(spark, sf_dir):
    return series.histogram(views.reviews(spark, sf_dir))


def _days(spark, sf_dir):
    """Event volume by day and event type, as a second series: types stand for apps."""
    e = views.table(spark, sf_dir, "events").select(
        (F.ascii("event_type") * 100 + F.length("event_type")).cast("long").alias("app_id"), F.col("ts").alias("created_at"), (F.col("value") > 50).alias("voted_up")
    )
    return series.histogram(e, "day")


def histogram(spark, sf_dir):
    return _months(spark, sf_dir)


def daily_histogram(spark, sf_dir):
    return _days(spark, sf_dir)


def yearly_rollup(spark, sf_dir):
    return series.rolled(_months(spark, sf_dir), "year")


def spikes(spark, sf_dir):
    # in the given tables volume is even, so the detector's factor is lowered to have something to find
    return series.spikes(_months(spark, sf_dir), floor=10, times=1.2).select("app_id", "start", "volume", "baseline", "ratio", "spike")


def thresholds(spark, sf_dir):
    """What the detector would flag at each of several factors."""
    return series.threshold_sweep(series.spikes(_months(spark, sf_dir), floor=10), [1.1, 1.2, 1.5, 2.0, 4.0], 10)


def _episodes(spark, sf_dir):
    return series.episodes(series.spikes(_months(spark, sf_dir), floor=10, times=1.2))


def episodes(spark, sf_dir):
    return _episodes(spark, sf_dir)


def _periods(spark, sf_dir):
    """Flagged periods: each app's tenth month from its first review, and three months from its fortieth."""
    first = views.reviews(spark, sf_dir).groupBy("app_id").agg(F.min("created_at").alias("first"))
    at = F.explode(F.array(F.struct(F.lit(10).alias("m"), F.lit(1).alias("k")), F.struct(F.lit(40).alias("m"), F.lit(3).alias("k"))))
    spans = first.select("app_id", F.date_trunc("month", "first").cast("timestamp_ntz").alias("s"), at.alias("x"))
    plus = lambda n: F.add_months("s", n).cast("timestamp_ntz")
    return spans.select("app_id", plus(F.col("x.m")).alias("start"), plus(F.col("x.m") + F.col("x.k")).alias("end"))


def flagged_episodes(spark, sf_dir):
    return series.flagged_overlap(_episodes(spark, sf_dir), _periods(spark, sf_dir))


def period_counts(spark, sf_dir):
    return series.period_counts(_periods(spark, sf_dir), views.reviews(spark, sf_dir))


def peak_share(spark, sf_dir):
    return series.peak_share(_months(spark, sf_dir))


MONTHS_SQL = """counted AS (SELECT app_id, date_trunc('month', created_at)::TIMESTAMP AS start, count(*) FILTER (voted_up) AS up, count(*) FILTER (NOT voted_up) AS down FROM reviews GROUP BY 1, 2),
calendar AS (SELECT app_id, unnest(generate_series(min(start), max(start), INTERVAL 1 MONTH)) AS start FROM counted GROUP BY app_id),
months AS (SELECT app_id, c.start, coalesce(up, 0) AS up, coalesce(down, 0) AS down FROM calendar c LEFT JOIN counted USING (app_id, start))"""
SPIKES_SQL = """placed AS (SELECT *, (up + down)::BIGINT AS volume, row_number() OVER w AS place,
  median((up + down)::DOUBLE) OVER (PARTITION BY app_id ORDER BY start ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS med,
  coalesce(lead(start) OVER w, start + (start - lag(start) OVER w), start + INTERVAL 30 DAY) AS "end" FROM months WINDOW w AS (PARTITION BY app_id ORDER BY start)),
spiked AS (SELECT app_id, start, "end", volume, place, CASE WHEN place > 6 THEN med END AS baseline,
  volume / nullif(CASE WHEN place > 6 THEN med END, 0) AS ratio,
  coalesce(volume >= 10 AND place > 6 AND med > 0 AND volume > 1.2 * med, false) AS spike FROM placed)"""
EPISODES_SQL = """islands AS (SELECT *, place - row_number() OVER (PARTITION BY app_id ORDER BY start) AS island FROM spiked WHERE spike),
episodes AS (SELECT app_id, min(start) AS start, max("end") AS "end", count(*) AS n_buckets, sum(volume)::BIGINT AS n_reviews, max(ratio) AS top_ratio FROM islands GROUP BY app_id, island)"""
PERIODS_SQL = """periods AS (SELECT app_id, (s + to_months(m))::TIMESTAMP AS start, (s + to_months(m + k))::TIMESTAMP AS "end"
  FROM (SELECT app_id, date_trunc('month', min(created_at)) AS s FROM reviews GROUP BY 1), (VALUES (10, 1), (40, 3)) AS x(m, k))"""
BASE = f"WITH {REVIEWS_SQL}, {MONTHS_SQL}"
ALL = f"{BASE}, {SPIKES_SQL}, {EPISODES_SQL}, {PERIODS_SQL}"

QUERIES = {
    "corpus_histogram": histogram, "year_rollup": yearly_rollup, "detect_spikes": spikes, "spike_episodes": episodes,
    "flagged_episodes": flagged_episodes, "period_counts": period_counts, "peak_window_share": peak_share, "daily_histogram": daily_histogram, "threshold_sweep": thresholds,
}
ORACLE = {
    "corpus_histogram": f"{BASE} SELECT * FROM months",
    "year_rollup": f"{BASE} SELECT app_id, date_trunc('year', start)::TIMESTAMP AS start, sum(up)::BIGINT AS up, sum(down)::BIGINT AS down FROM months GROUP BY 1, 2",
    "detect_spikes": f"{ALL} SELECT app_id, start, volume, baseline, ratio, spike FROM spiked",
    "spike_episodes": f"{ALL} SELECT * FROM episodes",
    "flagged_episodes": f"""{ALL} SELECT e.*, EXISTS (SELECT 1 FROM periods p WHERE p.app_id = e.app_id AND e.start < p."end" AND e."end" > p.start) AS flagged FROM episodes e""",
    "period_counts": f"""{ALL} SELECT p.app_id, p.start, p."end", count(r.created_at) AS n_reviews FROM periods p
        LEFT JOIN reviews r ON r.app_id = p.app_id AND r.created_at >= p.start AND r.created_at < p."end" GROUP BY 1, 2, 3""",
    "daily_histogram": """WITH e AS (SELECT (ascii(event_type) * 100 + length(event_type))::BIGINT AS app_id, date_trunc('day', ts)::TIMESTAMP AS start, value > 50 AS up FROM events), c AS (SELECT app_id, start, count(*) FILTER (up) AS up, count(*) FILTER (NOT up) AS down FROM e GROUP BY 1, 2),
        d AS (SELECT app_id, unnest(generate_series(min(start), max(start), INTERVAL 1 DAY)) AS start FROM c GROUP BY 1) SELECT app_id, d.start, coalesce(up, 0) AS up, coalesce(down, 0) AS down FROM d LEFT JOIN c USING (app_id, start)""",
    "threshold_sweep": f"""{ALL}, k AS (SELECT unnest([1.1, 1.2, 1.5, 2.0, 4.0]::DOUBLE[]) AS times), p AS (SELECT app_id, times, place, coalesce(volume >= 10 AND baseline > 0 AND volume > times * baseline, false) AS f FROM spiked, k),
        i AS (SELECT *, place - row_number() OVER (PARTITION BY app_id, times ORDER BY place) AS island FROM p WHERE f)
        SELECT app_id, times, count(*) AS buckets, count(*) FILTER (f) AS flagged, (SELECT count(DISTINCT island) FROM i WHERE i.app_id = p.app_id AND i.times = p.times) AS episodes FROM p GROUP BY 1, 2""",
    "peak_window_share": f"""{BASE}, t AS (SELECT app_id, max(up + down) AS peak, sum(up + down)::BIGINT AS total FROM months GROUP BY 1)
        SELECT app_id, peak, total, peak / total::DOUBLE AS peak_share, CASE WHEN peak / total::DOUBLE >= 2.0 / 3 THEN 'spiky' ELSE 'calm' END AS regime FROM t""",
}
