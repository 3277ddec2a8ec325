"""Queries of the whole sweep and of mixing, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearsay.operators import studies, sweeps
from hearsay.plans import studies as st

SIZES, REPEATS, BASE_SIZE, SHARES = [10, 20, 40], 3, 60, [0.0, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25]


def _pools(spark, sf_dir):
    members = st._members(spark, sf_dir)
    pools = studies.pools(members, st._grid(spark, sf_dir).drop("pool_size"))
    sizes = pools.groupBy("app_id", "quantile").agg(F.count("*").alias("pool_size"))
    return pools.join(sizes, ["app_id", "quantile"]).select("app_id", "quantile", "pool_size", "review_id", "created_at")


def policy_sweep(spark, sf_dir):
    """Three plans and uniform draws, of three sizes, from each pool."""
    return sweeps.whole_sweep(_pools(spark, sf_dir), st._hits(spark, sf_dir), st._regimes(spark), SIZES, REPEATS, "s")


def _mixed(spark, sf_dir):
    """Eight apps' samples, blended with early reviews of the ninth and late ones of the tenth."""
    members = st._members(spark, sf_dir)
    early, late = (F.col("app_id") == 8) & (F.col("created_at") < "1998-01-01"), (F.col("app_id") == 9) & (F.col("created_at") >= "1999-01-01")
    marked = members.select(F.when(early, "early").when(late, "late").alias("source"), "review_id").filter("source IS NOT NULL")
    pools = _pools(spark, sf_dir).filter("app_id < 8")
    base = sweeps.policy_draws(pools, [BASE_SIZE]).filter("policy = 'time-proportional'").select("app_id", "quantile", "review_id")
    return sweeps.mixing(pools, base, marked, st._hits(spark, sf_dir), st._regimes(spark), SHARES, REPEATS, "x")


def mixing_curve(spark, sf_dir):
    return _mixed(spark, sf_dir)


def mixing_floors(spark, sf_dir):
    """How much of each source a sample bears, by draw-weighted rates over pools."""
    return studies.floors(studies.register_reads(_mixed(spark, sf_dir)), 0.85)


def _marked(spark, sf_dir):
    m = st._members(spark, sf_dir).withColumn("source", (F.col("app_id") % 3).cast("string"))
    r = F.col("review_id").cast("long")
    usable = m.filter(r % 8 != 3).select("source", "review_id", "created_at")
    labelled = m.filter((r % 4 == 1) | (r % 40 == 3)).select("source", "review_id")
    windows = spark.range(2).select(F.col("id").cast("string").alias("source"), F.lit("1996-01-01").cast("timestamp_ntz").alias("start"), F.lit("2001-01-01").cast("timestamp_ntz").alias("end"))
    return usable, labelled, windows


def marked_faults(spark, sf_dir):
    """Labelled reviews of three sources that are not usable, lie outside of their source's window, or have none."""
    return sweeps.marked_faults(*_marked(spark, sf_dir)).groupBy("source", "fault").agg(F.count("*").alias("n"), F.min("review_id").alias("first"))


def marked_index(spark, sf_dir):
    """The index of the two sources with windows, once what is not in order is gone."""
    usable, labelled, windows = _marked(spark, sf_dir)
    bad = sweeps.marked_faults(usable, labelled, windows).select("source", "review_id")
    return sweeps.marked_pool(usable, labelled.join(bad, ["source", "review_id"], "left_anti"), windows, st._hits(spark, sf_dir))[1]


def pool_regimes(spark, sf_dir):
    return sweeps.regimes(_pools(spark, sf_dir), 0.03)


Q = st.BASE + f""", pw AS (SELECT app_id, quantile, date_trunc('month', created_at) AS start, count(*) AS population, any_value(pool_size) AS pool_size FROM pools GROUP BY 1, 2, 3),
zs AS (SELECT pw.*, s AS size, coalesce(sum(population) OVER (PARTITION BY app_id, quantile, s ORDER BY start DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later FROM pw, (SELECT unnest({[*SIZES, BASE_SIZE]}) AS s) WHERE s < pool_size),
qn AS (SELECT app_id, quantile, size, start, 'cursor-prefix' AS policy, greatest(0, least(population, size - later)) AS quota FROM zs),
pi AS (SELECT *, round(population * size::DOUBLE / pool_size, 6) AS ideal FROM zs), lv AS (SELECT *, row_number() OVER o AS j, count(*) OVER a AS m, sum(population) OVER (o ROWS UNBOUNDED PRECEDING) - population AS below FROM zs WINDOW a AS (PARTITION BY app_id, quantile, size), o AS (PARTITION BY app_id, quantile, size ORDER BY population, start)),
ll AS (SELECT app_id, quantile, size, max((size - below)::DOUBLE / (m - j + 1)) AS level FROM lv GROUP BY 1, 2, 3), ei AS (SELECT zs.*, round(least(population, level), 6) AS ideal FROM zs JOIN ll USING (app_id, quantile, size)),
al AS (SELECT app_id, quantile, size, start, 'time-proportional' AS policy, ideal FROM pi UNION ALL SELECT app_id, quantile, size, start, 'equal-per-window', ideal FROM ei),
qa AS (SELECT app_id, quantile, size, start, policy, floor(ideal)::BIGINT + (row_number() OVER (PARTITION BY app_id, quantile, size, policy ORDER BY ideal - floor(ideal) DESC, start) <= size - sum(floor(ideal)) OVER (PARTITION BY app_id, quantile, size, policy))::INT AS quota FROM al UNION ALL SELECT * FROM qn),
rk AS (SELECT *, date_trunc('month', created_at) AS start, row_number() OVER (PARTITION BY app_id, quantile, date_trunc('month', created_at) ORDER BY created_at DESC, review_id DESC) AS r FROM pools),
pd AS (SELECT rk.app_id, rk.quantile, size, policy, review_id FROM rk JOIN qa USING (app_id, quantile, start) WHERE r <= quota)"""


def _judged(cell: str, truth_on: str) -> str:
    """Measures of rows drawn(cell, review_id) against truth."""
    z = st._wilson
    return f"""dk AS (SELECT {cell}, aspect, count(*) AS k FROM drawn JOIN hits USING (review_id) GROUP BY ALL),
m0 AS (SELECT c.*, aspect, reference_share, coalesce(k, 0) AS k, CASE WHEN app_id % 3 = 0 THEN 'spiky' ELSE 'calm' END AS regime FROM (SELECT DISTINCT {cell} FROM drawn) c JOIN truth2 USING ({truth_on}) LEFT JOIN dk USING ({cell}, aspect)),
m1 AS (SELECT *, k / size::DOUBLE AS sample_share, abs(k / size::DOUBLE - reference_share) AS error, {z("k", "size", "-")} AS lo, {z("k", "size", "+")} AS hi, {st.BAND.format("reference_share")} AS band, {st.BAND.format("(k / size::DOUBLE)")} AS own FROM m0),
m AS (SELECT *, hi - lo AS width, lo <= reference_share AND reference_share <= hi AS covered, greatest(0, lo - {st.ALLOWED.format("own")}) <= reference_share AND reference_share <= least(1, hi + {st.ALLOWED.format("own")}) AS shipped_covered,
  error <= CASE WHEN band = 'tail' THEN 0.010 WHEN band = 'mid' AND regime = 'calm' THEN 0.025 END AS within_tolerance FROM m1)"""


SWEEP = f"""{Q}, un AS (SELECT p.*, t.i AS repeat, row_number() OVER (PARTITION BY app_id, quantile, t.i ORDER BY md5('s|' || t.i || '|' || review_id), review_id) AS rk FROM pools p, range({REPEATS}) t(i)),
drawn AS (SELECT app_id, quantile, size, 0 AS repeat, policy, review_id FROM pd WHERE size <> {BASE_SIZE} UNION ALL SELECT app_id, quantile, s, repeat::INT, 'uniform-random', review_id FROM un, (SELECT unnest({SIZES}) AS s) WHERE rk <= s AND s < pool_size),
truth2 AS (SELECT * FROM truth), {_judged("app_id, quantile, size, repeat, policy", "app_id, quantile")}"""
MIX = f"""{Q}, mk AS (SELECT CASE WHEN app_id = 8 THEN 'early' ELSE 'late' END AS source, review_id FROM reviews WHERE app_id = 8 AND created_at < TIMESTAMP '1998-01-01' OR app_id = 9 AND created_at >= TIMESTAMP '1999-01-01'),
bs AS (SELECT app_id, quantile, review_id FROM pd WHERE size = {BASE_SIZE} AND policy = 'time-proportional' AND app_id < 8), so AS (SELECT bs.*, source, t.i::INT AS repeat, row_number() OVER (PARTITION BY app_id, quantile, source, t.i ORDER BY md5('x|out|' || source || '|' || t.i || '|' || review_id), review_id) AS r FROM bs, (SELECT DISTINCT source FROM mk), range({REPEATS}) t(i)),
si AS (SELECT mk.*, t.i::INT AS repeat, row_number() OVER (PARTITION BY source, t.i ORDER BY md5('x|in|' || source || '|' || t.i || '|' || review_id), review_id) AS r FROM mk, range({REPEATS}) t(i)),
pl AS (SELECT app_id, quantile, source, share, t.i::INT AS repeat, {BASE_SIZE} AS size, floor(share * {BASE_SIZE} + 0.5) AS o FROM (SELECT DISTINCT app_id, quantile FROM bs), (SELECT DISTINCT source FROM mk), (SELECT unnest({SHARES}::DOUBLE[]) AS share), range({REPEATS}) t(i) WHERE share > 0 OR t.i = 0),
drawn AS (SELECT pl.* EXCLUDE o, review_id FROM pl JOIN so USING (app_id, quantile, source, repeat) WHERE r > o UNION ALL SELECT pl.* EXCLUDE o, review_id FROM pl JOIN si USING (source, repeat) WHERE r <= o),
va AS (SELECT DISTINCT source, aspect FROM mk JOIN hits USING (review_id)), truth2 AS (SELECT t.*, source FROM truth t, (SELECT DISTINCT source FROM mk) WHERE app_id < 8
  UNION ALL SELECT p.app_id, p.quantile, va.aspect, 0.0, source FROM (SELECT DISTINCT app_id, quantile FROM truth WHERE app_id < 8) p, va WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.app_id = p.app_id AND t.quantile = p.quantile AND t.aspect = va.aspect)),
{_judged("app_id, quantile, size, repeat, source, share", "app_id, quantile, source")},
curve AS (SELECT app_id, quantile, source, share, count(DISTINCT repeat) AS repeats, round(avg(error), 12) AS mean_error, max(error) AS max_error, avg(shipped_covered::INT) AS shipped_rate, avg(within_tolerance::INT) AS within_rate FROM m GROUP BY 1, 2, 3, 4)"""
MARKED = f"""{st.BASE}, mm AS (SELECT (app_id % 3)::VARCHAR AS source, review_id, created_at, review_id::BIGINT AS r FROM reviews), lb AS (SELECT *, r % 8 = 3 AS lost, created_at < TIMESTAMP '1996-01-01' OR created_at > TIMESTAMP '2001-01-01' AS out FROM mm WHERE r % 4 = 1 OR r % 40 = 3)"""
QUERIES = {"policy_sweep": policy_sweep, "mixing_curve": mixing_curve, "mixing_floors": mixing_floors, "marked_faults": marked_faults, "marked_index": marked_index, "pool_regimes": pool_regimes}
ORACLE = {
    "marked_faults": f"""{MARKED} SELECT source, CASE WHEN lost THEN 'labelled but not usable' WHEN source = '2' THEN 'no window' ELSE 'outside its window' END AS fault, count(*) AS n, min(review_id) AS first FROM lb WHERE lost OR source = '2' OR out GROUP BY 1, 2""",
    "marked_index": f"{MARKED} SELECT source, aspect, count(DISTINCT review_id) AS n FROM lb JOIN hits USING (review_id) WHERE NOT lost AND NOT out AND source <> '2' GROUP BY 1, 2",
    "pool_regimes": f"""{st.BASE}, mo AS (SELECT app_id, quantile, count(*) AS n FROM pools GROUP BY app_id, quantile, date_trunc('month', created_at)) SELECT app_id, quantile, sum(n)::BIGINT AS population, max(n) / sum(n)::DOUBLE AS peak_share, CASE WHEN max(n) / sum(n)::DOUBLE >= 0.03 THEN 'spiky' ELSE 'calm' END AS regime FROM mo GROUP BY 1, 2""",
    "policy_sweep": f"""{SWEEP} SELECT app_id, quantile, size, policy, aspect, count(*) AS repeats, any_value(reference_share) AS reference_share, any_value(band) AS band, avg(sample_share) AS mean_share, avg(error) AS mean_error, quantile_cont(error, 0.5) AS p50_error, quantile_cont(error, 0.9) AS p90_error,
      max(error) AS max_error, avg(covered::INT) AS coverage, avg(width) AS mean_width, avg(within_tolerance::INT) AS within_rate, avg(shipped_covered::INT) AS shipped_rate FROM m GROUP BY 1, 2, 3, 4, 5""",
    "mixing_curve": f"{MIX} SELECT * FROM curve",
    "mixing_floors": f"""{MIX}, rd AS (SELECT source, share, sum(shipped_rate * repeats) / sum(repeats) AS c, sum(within_rate * repeats) / nullif(sum(repeats) FILTER (within_rate IS NOT NULL), 0) AS w FROM curve GROUP BY 1, 2), p AS (SELECT *, c >= 0.85 AND coalesce(w >= 0.85, true) AS ok FROM rd)
      SELECT source, max(share) FILTER (NOT EXISTS (SELECT 1 FROM p q WHERE q.source = p.source AND q.share <= p.share AND NOT q.ok)) AS floor, bool_and(ok) AS censored, count(*) AS shares FROM p GROUP BY 1""",
}
