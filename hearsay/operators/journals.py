"""Operational marts over journals: the call ledger, admissions and refusals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def call_cost(prompt: Column, cached: Column, output: Column, fresh_rate: int, cached_rate: int, output_rate: int) -> Column:
    """Cost of a call in billionths, by rates per billion tokens: whole numbers, so that sums are exact in any order.

    Cached tokens are a part of the prompt's.
    """
    held = F.least(cached, prompt)
    return (prompt - held) * fresh_rate + held * cached_rate + output * output_rate


def daily_ledger(ledger: DataFrame) -> DataFrame:
    """Per day: calls, tokens and cost; prompt and cached tokens of measured calls only (with a duration); hit rate."""
    measured = F.col("duration_s").isNotNull()
    out = ledger.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"),
        F.sum(F.when(measured, F.col("prompt_tokens"))).alias("measured_prompt"), F.sum(F.when(measured, F.col("cached_tokens"))).alias("measured_cached"),
    )
    return out.withColumn("hit_rate", F.col("measured_cached") / F.nullif(F.col("measured_prompt").cast("double"), F.lit(0.0)))


def stage_totals(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("stage", "model").agg(F.count("*").alias("calls"), F.sum("cost").alias("cost"), F.max("created_at").alias("last_call"))


def nearest_rank(column: str, q: float) -> Column:
    """The value at place ceil(q * n) in ascending order."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})")


def stage_latencies(ledger: DataFrame) -> DataFrame:
    """Nearest-rank p50 and p95 of each stage's measured calls."""
    measured = ledger.filter("duration_s IS NOT NULL").groupBy("stage")
    return measured.agg(F.count("*").alias("n"), nearest_rank("duration_s", 0.5).alias("p50"), nearest_rank("duration_s", 0.95).alias("p95"))


def daily_table(ledger: DataFrame, admissions: DataFrame, refusals: DataFrame) -> DataFrame:
    """Three journals by day. Days without admissions or refusals count zero; without calls the cost stays undefined."""
    day = lambda df: df.groupBy(F.to_date("created_at").alias("day"))
    costs = day(ledger).agg(F.count("*").alias("calls"), F.sum("cost").alias("cost"))
    ins, outs = day(admissions).agg(F.count("*").alias("admitted")), day(refusals).agg(F.count("*").alias("refused"))
    out = costs.join(ins, "day", "full_outer").join(outs, "day", "full_outer")
    return out.select("day", "calls", "cost", F.coalesce("admitted", F.lit(0)).alias("admitted"), F.coalesce("refused", F.lit(0)).alias("refused"))


def recent_jobs(jobs: DataFrame, ledger: DataFrame, n: int) -> DataFrame:
    """The newest jobs with their cost and number of calls; jobs without calls cost 0."""
    spent = ledger.groupBy("job_id").agg(F.sum("cost").alias("c"), F.count("*").alias("k"))
    newest = jobs.orderBy(F.desc("started_at"), F.desc("job_id")).limit(n)
    return newest.join(spent, "job_id", "left").select("job_id", "started_at", F.coalesce("c", F.lit(0)).alias("cost"), F.coalesce("k", F.lit(0)).alias("calls"))


def unjournaled(ledger: DataFrame, jobs: DataFrame) -> DataFrame:
    """Calls and cost that no job accounts for; a call without a job counts."""
    return ledger.join(jobs.select("job_id"), "job_id", "left_anti").agg(F.count("*").alias("calls"), F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"))


def limited(requests: DataFrame, per_minute: int) -> DataFrame:
    """A fixed one-minute limiter per visitor: refused requests don't count, so the first ones of a minute pass."""
    minute = F.date_trunc("minute", "created_at")
    order = Window.partitionBy("visitor", minute).orderBy("created_at", "request_id")
    return requests.withColumn("admitted", F.row_number().over(order) <= per_minute)


def matched_pairs(left: DataFrame, right: DataFrame, keys: list[str], left_order: str, right_order: str) -> DataFrame:
    """Rows of two journals with equal keys, paired one to one in their orders."""
    a = left.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(left_order)))
    b = right.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(right_order)))
    return a.join(b, [*keys, "_n"]).drop("_n")
