"""Queries of the sampling study over survey reviews and their pinned aspects."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearsay import views
from hearsay.functions import intervals as iv
from hearsay.operators import series, studies
from hearsay.operators.aggregates import on_version
from hearsay.plans.marts import SCOPE
from hearsay.plans.series import MONTHS_SQL
from hearsay.views import ENVELOPES_SQL, MENTIONS_SQL, REVIEWS_SQL

QUANTILES, SIZES, REPEATS, SHARES = [0.25, 0.5, 0.75, 0.751, 1.0], [10, 20, 40], 3, [0.0, 0.05, 0.25]


def _members(spark, sf_dir):
    scope = views.envelopes(spark, sf_dir).filter(on_version()).select("review_id")
    return views.reviews(spark, sf_dir).join(scope, "review_id")


def _hits(spark, sf_dir):
    return views.mentions(spark, sf_dir).filter("slot = 'pinned'").select("review_id", "aspect").distinct()


def _grid(spark, sf_dir):
    return studies.anchors(series.histogram(_members(spark, sf_dir)), QUANTILES)


def _pools(spark, sf_dir):
    members = _members(spark, sf_dir)
    pools = studies.pools(members, _grid(spark, sf_dir).drop("pool_size"))
    sizes = pools.groupBy("app_id", "quantile").agg(F.count("*").alias("pool_size"))
    return pools.join(sizes, ["app_id", "quantile"]).select("app_id", "quantile", "pool_size", "review_id")


def _regimes(spark):
    """One app in three counts as spiky here; the given tables' volume is even."""
    return spark.range(10).select(F.col("id").alias("app_id"), F.when(F.col("id") % 3 == 0, "spiky").otherwise("calm").alias("regime"))


def _measured(spark, sf_dir):
    pools, hits = _pools(spark, sf_dir), _hits(spark, sf_dir)
    return studies.measured(studies.draws(pools, SIZES, REPEATS, "s"), hits, studies.reference(pools, hits), _regimes(spark))


def anchor_grid(spark, sf_dir):
    return _grid(spark, sf_dir)


def pool_shares(spark, sf_dir):
    return studies.reference(_pools(spark, sf_dir), _hits(spark, sf_dir))


def sweep(spark, sf_dir):
    return _measured(spark, sf_dir).drop("shipped_covered", "within_tolerance", "needed")


def sweep_cells(spark, sf_dir):
    return studies.cells(_measured(spark, sf_dir))


def allowance_mint(spark, sf_dir):
    return studies.smoothed(studies.flat_allowances(_measured(spark, sf_dir)))


def _gates(spark, sf_dir):
    c = studies.cells(_measured(spark, sf_dir))
    return c.select(F.col("app_id").alias("source"), (F.col("size") / 10.0 - 1).alias("share"), "repeats", "within_rate", "shipped_rate")


def register_reads(spark, sf_dir):
    return studies.register_reads(_gates(spark, sf_dir))


def floors(spark, sf_dir):
    return studies.floors(studies.register_reads(_gates(spark, sf_dir)), 0.85)


def _closing(spark, sf_dir):
    """The first repeat of each cell; those of the smallest size stand for cells that took all, some of them not exact."""
    m = _measured(spark, sf_dir).filter("repeat = 0")
    take_all = F.col("size") == SIZES[0]
    error = F.when(take_all, F.when(F.length("aspect") % 23 == 0, F.col("error")).otherwise(0.0)).otherwise(F.col("error"))
    none = lambda c: F.when(~take_all, F.col(c)).alias(c)
    return m.select("app_id", "band", take_all.alias("take_all"), error.alias("error"), none("within_tolerance"), none("shipped_covered"))


def closing_verdicts(spark, sf_dir):
    return studies.game_verdicts(_closing(spark, sf_dir), 0.9)


def band_reads(spark, sf_dir):
    return studies.sampled_reads(_closing(spark, sf_dir), "band")


def mixing(spark, sf_dir):
    """Samples that reviews of 1996 are swapped into, as if they were marked: how many, and how far shares move."""
    m = _members(spark, sf_dir)
    marked = m.filter("created_at >= '1996-01-01' AND created_at < '1997-01-01'").select("app_id", "review_id")
    rank = "row_number() OVER (PARTITION BY app_id ORDER BY created_at DESC, review_id DESC)"
    sample = m.filter("created_at < '1996-01-01'").withColumn("rank", F.expr(rank)).filter("rank <= 60").select("app_id", "review_id")
    mixed = studies.contaminated(sample, marked, SHARES, "m")
    swapped = mixed.join(marked.select("review_id", F.lit(1).alias("m")), "review_id", "left")
    return swapped.groupBy("app_id", "share").agg(F.count("*").alias("n"), F.count("m").alias("swapped"), F.min("review_id").alias("least"), F.max("review_id").alias("most"))


def shape_groups(spark, sf_dir):
    peak = series.peak_share(series.histogram(_members(spark, sf_dir)))
    shares = studies.reference(_pools(spark, sf_dir), _hits(spark, sf_dir)).filter("quantile = 1.0").select("app_id", F.col("reference_share").alias("share"))
    rows = studies.terciles(peak.select("app_id", "peak_share"), "peak_share", "app_id").join(studies.headline_aspects(shares, 0.02), "app_id")
    return rows.withColumn("group", F.when(F.col("headline_aspects") >= 2, "2+").otherwise(F.col("headline_aspects").cast("string")))


def wiring(spark, sf_dir):
    """Shares over the last pools against shares by direct counting, which must be equal, with one aspect left out on purpose."""
    m, hits = _pools(spark, sf_dir).filter("quantile = 1.0"), _hits(spark, sf_dir)
    n = m.groupBy("app_id").agg(F.count("*").alias("n"))
    direct = m.join(hits, "review_id").groupBy("app_id", "aspect").agg(F.count("*").alias("k")).join(n, "app_id").select("app_id", "aspect", (F.col("k") / F.col("n")).alias("share"))
    pools = studies.reference(_pools(spark, sf_dir), hits).filter("quantile = 1.0").select("app_id", "aspect", F.col("reference_share").alias("share"))
    return studies.drifted(pools.filter("aspect NOT LIKE 'PROMO%' AND share > 0"), direct)


def error_curves(spark, sf_dir):
    """Signed bias and errors per size and band."""
    m = _measured(spark, sf_dir).withColumn("bias", F.col("sample_share") - F.col("reference_share"))
    return m.groupBy("size", "band").agg(
        F.count("*").alias("n"), F.percentile("bias", 0.1).alias("bias_p10"), F.percentile("bias", 0.5).alias("bias_p50"), F.percentile("bias", 0.9).alias("bias_p90"), F.percentile("error", 0.9).alias("error_p90"),
        F.avg(F.col("covered").cast("double")).alias("coverage"))


def ruling_table(spark, sf_dir):
    """Per regime and band: the order statistics of errors and of needed inflation at 95 %, and the constant in force."""
    m = _measured(spark, sf_dir)
    at = lambda c: F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {c})")
    return m.groupBy("regime", "band").agg(F.count("*").alias("n"), at("error").alias("p95_error"), at("needed").alias("p95_needed"), F.max(iv.allowance(F.col("regime"), F.col("band"))).alias("shipped"))


def exact_intervals(spark, sf_dir):
    """Exact and shipped intervals of each app's aspects."""
    n = _members(spark, sf_dir).groupBy("app_id").agg(F.count("*").alias("n"))
    k = _members(spark, sf_dir).join(_hits(spark, sf_dir), "review_id").groupBy("app_id", "aspect").agg(F.count("*").alias("hits"))
    rows = k.join(n, "app_id").join(_regimes(spark), "app_id").select("app_id", "aspect", "regime", iv.guarded(F.col("hits"), F.col("n")).alias("k"), "n")
    low, high = iv.shipped(F.col("k"), F.col("n"), F.col("regime"))
    return iv.exact_bounds(rows, "k", "n").select("app_id", "aspect", "k", "n", "exact_low", "exact_high", low.alias("low"), high.alias("high"))


def recomposed(spark, sf_dir):
    m = _members(spark, sf_dir)
    r = F.col("review_id").cast("long")
    gold = m.filter((r % 16 == 0) & (F.col("app_id") < 4))
    fillers = m.filter((r % 16 != 0) & ((F.col("app_id") != 2) | (r % 29 == 3)))
    b = studies.recomposed(gold, fillers)
    return b.groupBy("batch").agg(F.count("*").alias("n"), F.count_if("is_gold").alias("gold"), F.min("review_id").alias("least"), F.max("review_id").alias("most"))


def systematic_sample(spark, sf_dir):
    """Every 37th envelope in the order of app and id, with whether it is empty."""
    empty = views.mentions(spark, sf_dir).select("review_id").distinct().withColumn("has", F.lit(True))
    frame = _members(spark, sf_dir).select("app_id", "review_id").join(empty, "review_id", "left").select("app_id", "review_id", F.col("has").isNull().alias("is_empty"))
    return studies.systematic(frame, 37, 5, "app_id", "review_id")


def _wilson(k, n, sign):
    z = "1.959963984540054"
    edge = f"(({k})::DOUBLE / {n} + {z}*{z}/(2*{n})) / (1 + {z}*{z}/{n}) {sign} {z} * sqrt((({k})::DOUBLE/{n})*(1-({k})::DOUBLE/{n})/{n} + {z}*{z}/(4.0*{n}*{n})) / (1 + {z}*{z}/{n})"
    return f"{'greatest(0.0' if sign == '-' else 'least(1.0'}, {edge})"


BAND = "CASE WHEN {0} < 0.05 THEN 'tail' WHEN {0} < 0.15 THEN 'mid' ELSE 'headline' END"
ALLOWED = "CASE WHEN regime = 'spiky' AND {0} = 'mid' THEN 0.017 WHEN regime = 'spiky' AND {0} = 'headline' THEN 0.127 ELSE 0.0 END"
BASE = f"""WITH raw AS (WITH {REVIEWS_SQL} SELECT * FROM reviews), {ENVELOPES_SQL}, {MENTIONS_SQL}, reviews AS (SELECT * FROM raw WHERE review_id IN (SELECT review_id FROM envelopes WHERE {SCOPE})), {MONTHS_SQL},
hits AS (SELECT DISTINCT review_id, aspect FROM mentions WHERE slot = 'pinned'), pop AS (SELECT * FROM months WHERE up + down > 0), life AS (SELECT app_id, epoch_us(min(start)) AS a, epoch_us(max(start)) AS z FROM pop GROUP BY 1),
cuts AS (SELECT app_id, q AS quantile, make_timestamp(CAST(a + round(q * (z - a)) AS BIGINT)) AS cutoff FROM life, (SELECT unnest({QUANTILES}::DOUBLE[]) AS q)),
sized AS (SELECT app_id, quantile, cutoff, sum(up + down)::BIGINT AS pool_size FROM cuts JOIN pop USING (app_id) WHERE start <= cutoff GROUP BY ALL),
grid AS (SELECT app_id, min(quantile) AS quantile, min(cutoff) AS cutoff, pool_size FROM sized GROUP BY app_id, pool_size),
pools AS (SELECT r.app_id, quantile, count(*) OVER (PARTITION BY r.app_id, quantile) AS pool_size, review_id, created_at FROM reviews r JOIN grid g ON g.app_id = r.app_id AND created_at <= cutoff),
aspects AS (SELECT DISTINCT app_id, aspect FROM pools JOIN hits USING (review_id)), counts AS (SELECT app_id, quantile, aspect, count(*) AS k FROM pools JOIN hits USING (review_id) GROUP BY ALL),
truth AS (SELECT app_id, quantile, aspect, coalesce(k, 0) / pool::DOUBLE AS reference_share FROM (SELECT app_id, quantile, count(*) AS pool FROM pools GROUP BY ALL) p JOIN aspects USING (app_id) LEFT JOIN counts USING (app_id, quantile, aspect))"""
SWEEP = f"""{BASE}, ranked AS (SELECT p.*, t.i AS repeat, row_number() OVER (PARTITION BY app_id, quantile, t.i ORDER BY md5('s|' || t.i || '|' || review_id), review_id) AS rk FROM pools p, range({REPEATS}) t(i)),
drawn AS (SELECT app_id, quantile, s AS size, repeat::INT AS repeat, review_id FROM ranked, (SELECT unnest({SIZES}) AS s) WHERE rk <= s AND s < pool_size),
dk AS (SELECT app_id, quantile, size, repeat, aspect, count(*) AS k FROM drawn JOIN hits USING (review_id) GROUP BY ALL),
m0 AS (SELECT c.*, aspect, reference_share, coalesce(k, 0) AS k, CASE WHEN app_id % 3 = 0 THEN 'spiky' ELSE 'calm' END AS regime FROM (SELECT DISTINCT app_id, quantile, size, repeat FROM drawn) c JOIN truth USING (app_id, quantile) LEFT JOIN dk USING (app_id, quantile, size, repeat, aspect)),
m1 AS (SELECT *, k / size::DOUBLE AS sample_share, abs(k / size::DOUBLE - reference_share) AS error, {_wilson("k", "size", "-")} AS lo, {_wilson("k", "size", "+")} AS hi, {BAND.format("reference_share")} AS band, {BAND.format("(k / size::DOUBLE)")} AS own FROM m0),
m AS (SELECT *, hi - lo AS width, lo <= reference_share AND reference_share <= hi AS covered, greatest(0, lo - {ALLOWED.format("own")}) <= reference_share AND reference_share <= least(1, hi + {ALLOWED.format("own")}) AS shipped_covered,
  error <= CASE WHEN band = 'tail' THEN 0.010 WHEN band = 'mid' AND regime = 'calm' THEN 0.025 END AS within_tolerance, greatest(0, error - (hi - lo) / 2) AS needed FROM m1),
cells AS (SELECT app_id, quantile, size, aspect, count(*) AS repeats, any_value(reference_share) AS reference_share, any_value(band) AS band, avg(sample_share) AS mean_share, avg(error) AS mean_error, quantile_cont(error, 0.5) AS p50_error, quantile_cont(error, 0.9) AS p90_error,
  max(error) AS max_error, avg(covered::INT) AS coverage, avg(width) AS mean_width, avg(within_tolerance::INT) AS within_rate, avg(shipped_covered::INT) AS shipped_rate FROM m GROUP BY ALL),
gates AS (SELECT app_id AS source, size / 10.0::DOUBLE - 1 AS share, repeats, within_rate, shipped_rate FROM cells),
reads AS (SELECT source, share, sum(within_rate * repeats) / nullif(sum(repeats) FILTER (within_rate IS NOT NULL), 0)::DOUBLE AS tolerance_rate, sum(shipped_rate * repeats) / sum(repeats)::DOUBLE AS coverage_rate,
  coalesce(sum(repeats) FILTER (within_rate IS NOT NULL), 0)::BIGINT AS tolerance_draws, sum(repeats)::BIGINT AS coverage_draws FROM gates GROUP BY 1, 2),
closing AS (SELECT app_id, band, size = {SIZES[0]} AS take_all, CASE WHEN size = {SIZES[0]} THEN CASE WHEN length(aspect) % 23 = 0 THEN error ELSE 0 END ELSE error END AS error, CASE WHEN size <> {SIZES[0]} THEN within_tolerance END AS within_tolerance, CASE WHEN size <> {SIZES[0]} THEN shipped_covered END AS shipped_covered FROM m WHERE repeat = 0)"""
FLAT = """flat AS (SELECT r AS regime, band, size, count(*) AS n, quantile_disc(needed, 0.95) AS allowance FROM m, (SELECT unnest(['own', 'flat']) AS w), LATERAL (SELECT CASE WHEN w = 'own' THEN regime ELSE 'flat' END AS r) GROUP BY 1, 2, 3)"""
DISC = "list_sort(list({0}))[ceil(0.95 * count(*))::INT]"

QUERIES = {
    "anchor_grid": anchor_grid, "pool_shares": pool_shares, "sweep": sweep, "sweep_cells": sweep_cells, "allowance_mint": allowance_mint, "register_reads": register_reads, "contamination_floors": floors,
    "closing_verdicts": closing_verdicts, "band_reads": band_reads, "contaminated_samples": mixing, "shape_groups": shape_groups, "wiring_guard": wiring, "error_curves": error_curves, "ruling_table": ruling_table,
    "exact_intervals": exact_intervals, "recomposed_batches": recomposed, "systematic_sample": systematic_sample,
}
ORACLE = {
    "anchor_grid": f"{BASE} SELECT * FROM grid",
    "pool_shares": f"{BASE} SELECT * FROM truth",
    "sweep": f"{SWEEP} SELECT app_id, quantile, size, repeat, aspect, regime, reference_share, sample_share, error, width, band, covered FROM m",
    "sweep_cells": f"{SWEEP} SELECT * FROM cells",
    "allowance_mint": f"""{SWEEP}, b AS (SELECT unnest([regime, 'flat']) AS regime, band, size, needed FROM m), f AS (SELECT regime, band, size, count(*) AS n, {DISC.format("needed")} AS allowance FROM b GROUP BY 1, 2, 3)
        SELECT *, greatest(allowance, lag(allowance) OVER w, lead(allowance) OVER w) AS smoothed FROM f WINDOW w AS (PARTITION BY regime, band ORDER BY size)""",
    "register_reads": f"{SWEEP} SELECT * FROM reads",
    "contamination_floors": f"""{SWEEP}, p AS (SELECT *, coverage_rate >= 0.85 AND coalesce(tolerance_rate >= 0.85, true) AS ok FROM reads)
        SELECT source, max(share) FILTER (NOT EXISTS (SELECT 1 FROM p q WHERE q.source = p.source AND q.share <= p.share AND NOT q.ok)) AS floor, bool_and(ok) AS censored, count(*) AS shares FROM p GROUP BY 1""",
    "closing_verdicts": f"""{SWEEP}, v AS (SELECT app_id, count(*) FILTER (take_all AND error = 0) AS exact_cells, coalesce(bool_and(error = 0) FILTER (take_all), true) AS exact, avg(shipped_covered::INT) AS coverage, avg(within_tolerance::INT) AS within FROM closing GROUP BY 1)
        SELECT *, exact AND (coverage IS NULL OR coverage >= 0.9 AND coalesce(within >= 0.9, true)) AS passes FROM v""",
    "band_reads": f"{SWEEP} SELECT band, avg(within_tolerance::INT) AS tolerance_rate, avg(shipped_covered::INT) AS coverage_rate, count(within_tolerance) AS tolerance_cells, count(*) AS coverage_cells FROM closing WHERE NOT take_all GROUP BY 1",
    "contaminated_samples": f"""{BASE}, mk AS (SELECT app_id, review_id FROM reviews WHERE created_at >= TIMESTAMP '1996-01-01' AND created_at < TIMESTAMP '1997-01-01'), sm AS (SELECT app_id, review_id FROM reviews WHERE created_at < TIMESTAMP '1996-01-01' QUALIFY row_number() OVER (PARTITION BY app_id ORDER BY created_at DESC, review_id DESC) <= 60),
        pl AS (SELECT app_id, share, floor(share * count(*) + 0.5) AS o FROM sm, (SELECT unnest({SHARES}::DOUBLE[]) AS share) WHERE app_id IN (SELECT app_id FROM mk) GROUP BY 1, 2),
        so AS (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY md5('m-out|' || review_id), review_id) AS rk FROM sm), si AS (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY md5('m-in|' || review_id), review_id) AS rk FROM mk),
        x AS (SELECT app_id, share, review_id, 0 AS s FROM so JOIN pl USING (app_id) WHERE rk > o UNION ALL SELECT app_id, share, review_id, 1 FROM si JOIN pl USING (app_id) WHERE rk <= o)
        SELECT app_id, share, count(*) AS n, sum(s)::BIGINT AS swapped, min(review_id) AS least, max(review_id) AS most FROM x GROUP BY 1, 2""",
    "shape_groups": f"""{BASE}, pk AS (SELECT app_id, max(up + down) / sum(up + down)::DOUBLE AS peak_share FROM months GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY peak_share, app_id) - 1 AS rk, count(*) OVER () // 3 AS third_n FROM pk),
        h AS (SELECT app_id, count(*) FILTER (reference_share >= 0.02) AS headline_aspects FROM truth WHERE quantile = 1.0 GROUP BY 1)
        SELECT app_id, peak_share, CASE WHEN rk < third_n THEN 'low' WHEN rk < 2 * third_n THEN 'middle' ELSE 'high' END AS third, headline_aspects, CASE WHEN headline_aspects >= 2 THEN '2+' ELSE headline_aspects::VARCHAR END AS "group" FROM r JOIN h USING (app_id)""",
    "wiring_guard": f"""{BASE} SELECT app_id, aspect, reference_share AS share, 'second' AS side FROM truth WHERE quantile = 1.0 AND aspect LIKE 'PROMO%' AND reference_share > 0""",
    "error_curves": f"""{SWEEP} SELECT size, band, count(*) AS n, quantile_cont(sample_share - reference_share, 0.1) AS bias_p10, quantile_cont(sample_share - reference_share, 0.5) AS bias_p50, quantile_cont(sample_share - reference_share, 0.9) AS bias_p90, quantile_cont(error, 0.9) AS error_p90, avg(covered::INT) AS coverage FROM m GROUP BY 1, 2""",
    "ruling_table": f"""{SWEEP} SELECT regime, band, count(*) AS n, {DISC.format("error")} AS p95_error, {DISC.format("needed")} AS p95_needed, max({ALLOWED.format("band")})::DOUBLE AS shipped FROM m GROUP BY 1, 2""",
    "exact_intervals": f"""{BASE}, n AS (SELECT app_id, count(*) AS n FROM reviews GROUP BY 1), k AS (SELECT app_id, aspect, count(*) AS k, any_value(n) AS n, CASE WHEN app_id % 3 = 0 THEN 'spiky' ELSE 'calm' END AS regime FROM reviews JOIN hits USING (review_id) JOIN n USING (app_id) GROUP BY app_id, aspect),
        d AS (SELECT DISTINCT k, n FROM k WHERE k < n), c AS (SELECT k, n, i, sum(exp(lgamma(n + 1.0) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1.0) END - CASE WHEN i = n THEN 0 ELSE lgamma(n - i + 1.0) END + i * ln(k / n::DOUBLE) + (n - i) * ln(1 - k / n::DOUBLE))) OVER (PARTITION BY k, n ORDER BY i) AS p FROM (SELECT k, n, unnest(range(0, n + 1)) AS i FROM d)),
        b AS (SELECT k, n, min(i) FILTER (p >= 0.025) / n::DOUBLE AS lo, min(i) FILTER (p >= 0.975) / n::DOUBLE AS hi FROM c GROUP BY 1, 2)
        SELECT app_id, aspect, k.k, k.n, coalesce(lo, 1.0) AS exact_low, coalesce(hi, 1.0) AS exact_high, greatest(0, {_wilson("k.k", "k.n", "-")} - {ALLOWED.format(BAND.format("(k.k / k.n::DOUBLE)"))}) AS low, least(1, {_wilson("k.k", "k.n", "+")} + {ALLOWED.format(BAND.format("(k.k / k.n::DOUBLE)"))}) AS high FROM k LEFT JOIN b ON b.k = k.k AND b.n = k.n""",
    "recomposed_batches": f"""{BASE}, v AS (SELECT app_id, review_id, CAST(review_id AS BIGINT) AS r FROM reviews), g AS (SELECT app_id, review_id AS batch, row_number() OVER (PARTITION BY app_id ORDER BY review_id) - 1 AS turn FROM v WHERE r % 16 = 0 AND app_id < 4),
        f AS (SELECT app_id, review_id, (row_number() OVER (PARTITION BY app_id ORDER BY md5('r-f|' || review_id), review_id) - 1) // 9 AS turn FROM v WHERE r % 16 <> 0 AND (app_id <> 2 OR r % 29 = 3)), mt AS (SELECT f.review_id, g.batch FROM f LEFT JOIN g USING (app_id, turn)),
        sh AS (SELECT batch, 9 - count(mt.review_id) AS short FROM g LEFT JOIN mt USING (batch) GROUP BY 1), sl AS (SELECT batch, row_number() OVER (ORDER BY batch, i) AS slot FROM sh, range(9) t(i) WHERE i < short),
        sp AS (SELECT review_id, row_number() OVER (ORDER BY md5('r-t|' || review_id), review_id) AS slot FROM mt WHERE batch IS NULL), al AS (SELECT batch, review_id, 0 AS gold FROM mt WHERE batch IS NOT NULL UNION ALL SELECT batch, review_id, 0 FROM sl JOIN sp USING (slot) UNION ALL SELECT batch, batch, 1 FROM g)
        SELECT batch, count(*) AS n, sum(gold)::BIGINT AS gold, min(review_id) AS least, max(review_id) AS most FROM al GROUP BY 1""",
    "systematic_sample": f"""{BASE}, f AS (SELECT app_id, review_id, review_id NOT IN (SELECT review_id FROM mentions) AS is_empty, row_number() OVER (ORDER BY app_id, review_id) - 1 AS p FROM reviews) SELECT review_id, app_id, is_empty FROM f WHERE p >= 5 AND (p - 5) % 37 = 0""",
}
