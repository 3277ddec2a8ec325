"""Queries over journals; events stand for calls, requests and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearsay import views
from hearsay.operators import journals


def ledger(spark, sf_dir):
    """Every event is a call: stage = event type, its k as tokens, a duration on nine in ten, a job on six in seven."""
    e = views.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    prompt, cached, output = k * 100, (k * F.col("user_id")) % 700, k
    job = F.when(F.col("event_id") % 7 != 0, F.col("user_id"))
    return e.select(
        "event_id", F.col("ts").alias("created_at"), F.col("event_type").alias("stage"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
        prompt.alias("prompt_tokens"), cached.alias("cached_tokens"), output.alias("output_tokens"), F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("duration_s"),
        journals.call_cost(prompt, cached, output, 100, 25, 400).alias("cost"), job.alias("job_id"), "user_id",
    )


def jobs(spark, sf_dir):
    """A job for each user of an even id, started at their first event."""
    return views.table(spark, sf_dir, "events").filter(F.col("user_id") % 2 == 0).groupBy(F.col("user_id").alias("job_id")).agg(F.min("ts").alias("started_at"))


def daily(spark, sf_dir):
    return journals.daily_ledger(ledger(spark, sf_dir))


def totals(spark, sf_dir):
    return journals.stage_totals(ledger(spark, sf_dir))


def latencies(spark, sf_dir):
    return journals.stage_latencies(ledger(spark, sf_dir))


def daily_table(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    return journals.daily_table(rows.filter("stage = 'purchase'"), rows.filter("stage = 'signup'"), rows.filter("stage = 'error' AND prompt_tokens > 9500"))


def recent_jobs(spark, sf_dir):
    return journals.recent_jobs(jobs(spark, sf_dir), ledger(spark, sf_dir), 20)


def unjournaled(spark, sf_dir):
    return journals.unjournaled(ledger(spark, sf_dir), jobs(spark, sf_dir))


def limiter(spark, sf_dir):
    """A limiter of one request per event type and minute."""
    requests = ledger(spark, sf_dir).select(F.col("event_id").alias("request_id"), F.col("stage").alias("visitor"), "created_at")
    return journals.limited(requests, 1).groupBy("visitor").agg(F.count_if("admitted").alias("n_admitted"), F.count_if(~F.col("admitted")).alias("n_refused"))


def repriced(spark, sf_dir):
    """Ledger rows paired with archived bodies of equal model and output tokens, one to one, and the cost at new rates."""
    rows = ledger(spark, sf_dir)
    left = rows.filter("stage = 'click'").select("model", "output_tokens", "event_id", "prompt_tokens", "cost")
    right = rows.filter("stage = 'view'").select("model", "output_tokens", F.col("event_id").alias("body_id"), F.col("cached_tokens").alias("body_cached"))
    pairs = journals.matched_pairs(left, right, ["model", "output_tokens"], "event_id", "body_id")
    new = journals.call_cost(F.col("prompt_tokens"), F.col("body_cached"), F.col("output_tokens"), 100, 25, 400)
    return pairs.select("event_id", "body_id", "cost", new.alias("new_cost"))


COST = "(p - least(c, p)) * 100 + least(c, p) * 25 + o * 400"
BASE = f"""WITH k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
t AS (SELECT *, k * 100 AS p, (k * user_id) % 700 AS c, k AS o FROM k),
ledger AS (SELECT event_id, ts AS created_at, event_type AS stage, 'm' || (user_id % 3) AS model, p AS prompt_tokens, c AS cached_tokens, o AS output_tokens,
  CASE WHEN event_id % 10 <> 0 THEN value END AS duration_s, {COST} AS cost, CASE WHEN event_id % 7 <> 0 THEN user_id END AS job_id FROM t),
jobs AS (SELECT user_id AS job_id, min(ts) AS started_at FROM events WHERE user_id % 2 = 0 GROUP BY 1)"""

QUERIES = {
    "daily_ledger": daily, "stage_model_totals": totals, "stage_latencies": latencies, "daily_table": daily_table, "recent_jobs": recent_jobs,
    "unjournaled_totals": unjournaled, "minute_limiter": limiter, "reprice_ledger": repriced,
}
ORACLE = {
    "daily_ledger": f"""{BASE} SELECT created_at::DATE AS day, count(*) AS calls, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cost)::BIGINT AS cost,
        sum(prompt_tokens) FILTER (duration_s IS NOT NULL)::BIGINT AS measured_prompt, sum(cached_tokens) FILTER (duration_s IS NOT NULL)::BIGINT AS measured_cached,
        sum(cached_tokens) FILTER (duration_s IS NOT NULL) / nullif(sum(prompt_tokens) FILTER (duration_s IS NOT NULL), 0)::DOUBLE AS hit_rate FROM ledger GROUP BY 1""",
    "stage_model_totals": f"{BASE} SELECT stage, model, count(*) AS calls, sum(cost)::BIGINT AS cost, max(created_at) AS last_call FROM ledger GROUP BY 1, 2",
    "stage_latencies": f"""{BASE} SELECT stage, count(*) AS n, quantile_disc(duration_s, 0.5) AS p50, quantile_disc(duration_s, 0.95) AS p95 FROM ledger WHERE duration_s IS NOT NULL GROUP BY 1""",
    "daily_table": f"""{BASE}, a AS (SELECT created_at::DATE AS day, count(*) AS calls, sum(cost)::BIGINT AS cost FROM ledger WHERE stage = 'purchase' GROUP BY 1),
        b AS (SELECT created_at::DATE AS day, count(*) AS admitted FROM ledger WHERE stage = 'signup' GROUP BY 1),
        r AS (SELECT created_at::DATE AS day, count(*) AS refused FROM ledger WHERE stage = 'error' AND prompt_tokens > 9500 GROUP BY 1)
        SELECT day, calls, cost, coalesce(admitted, 0) AS admitted, coalesce(refused, 0) AS refused FROM a FULL JOIN b USING (day) FULL JOIN r USING (day)""",
    "recent_jobs": f"""{BASE}, n AS (SELECT * FROM jobs ORDER BY started_at DESC, job_id DESC LIMIT 20)
        SELECT job_id, started_at, coalesce(sum(cost), 0)::BIGINT AS cost, count(event_id) AS calls FROM n LEFT JOIN ledger USING (job_id) GROUP BY 1, 2""",
    "unjournaled_totals": f"{BASE} SELECT count(*) AS calls, coalesce(sum(cost), 0)::BIGINT AS cost FROM ledger l WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.job_id = l.job_id)",
    "minute_limiter": f"""{BASE}, r AS (SELECT stage, row_number() OVER (PARTITION BY stage, date_trunc('minute', created_at) ORDER BY created_at, event_id) <= 1 AS ok FROM ledger)
        SELECT stage AS visitor, count(*) FILTER (ok) AS n_admitted, count(*) FILTER (NOT ok) AS n_refused FROM r GROUP BY 1""",
    "reprice_ledger": f"""{BASE}, a AS (SELECT *, row_number() OVER (PARTITION BY model, output_tokens ORDER BY event_id) AS n FROM ledger WHERE stage = 'click'),
        b AS (SELECT model, output_tokens, event_id AS body_id, cached_tokens AS bc, row_number() OVER (PARTITION BY model, output_tokens ORDER BY event_id) AS n FROM ledger WHERE stage = 'view')
        SELECT a.event_id, body_id, cost, (prompt_tokens - least(bc, prompt_tokens)) * 100 + least(bc, prompt_tokens) * 25 + output_tokens * 400 AS new_cost FROM a JOIN b USING (model, output_tokens, n)""",
}
