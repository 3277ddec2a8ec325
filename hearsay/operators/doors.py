"""Write doors: what must hold before rows are appended, as queries that list faults; and what an append adds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def insert_faults(stored: DataFrame, arriving: DataFrame, keys: list[str], parents: DataFrame | None = None, parent_key: str | None = None) -> DataFrame:
    """keys and fault for arriving rows that are stored already, come twice, or lack their parent (parents: parent_key)."""
    there = stored.select(*keys).distinct().withColumn("_there", F.lit(True))
    rows = arriving.withColumn("_times", F.count("*").over(Window.partitionBy(*keys))).join(there, keys, "left")
    orphan = F.lit(False)
    if parents is not None:
        rows = rows.join(parents.select(parent_key).distinct().withColumn("_parent", F.lit(True)), parent_key, "left")
        orphan = F.col("_parent").isNull()
    fault = F.when(F.col("_there").isNotNull(), "stored already").when(F.col("_times") > 1, "comes twice").when(orphan, "no parent")
    return rows.select(*keys, fault.alias("fault")).filter("fault IS NOT NULL")


def append(arriving: DataFrame, faults: DataFrame, folder: str) -> int:
    """Appends all rows, or raises and appends none; the number of rows."""
    first = faults.limit(5).collect()
    if first:
        raise ValueError(f"nothing was written: {[tuple(r) for r in first]}")
    seen = Observation("append")
    arriving.observe(seen, F.count("*").alias("n")).write.mode("append").parquet(folder)  # counted as it is written
    return seen.get["n"]


def put_archive(stored: DataFrame, arriving: DataFrame, key: str = "key", body: str = "body") -> DataFrame:
    """What a content-addressed archive does with arriving bodies: key, outcome (new, same, conflict); new rows of one key count
    once if they are equal, and conflict if not."""
    a = arriving.groupBy(key).agg(F.min(body).alias("a"), F.max(body).alias("z"))
    both = a.join(stored.select(key, F.col(body).alias("held")), key, "left")
    outcome = F.when(F.col("a") != F.col("z"), "conflict").when(F.col("held").isNull(), "new").when(F.col("held") == F.col("a"), "same").otherwise("conflict")
    return both.select(key, outcome.alias("outcome"))


def settled(jobs: DataFrame, settlements: DataFrame) -> DataFrame:
    """job_id, fault: settlements of no job, of one that is settled, and second ones."""
    s = settlements.groupBy("job_id").agg(F.count("*").alias("times"))
    both = s.join(jobs.select("job_id", "settled"), "job_id", "left")
    fault = F.when(F.col("settled").isNull(), "no such job").when(F.col("settled"), "settled already").when(F.col("times") > 1, "settled twice")
    return both.select("job_id", fault.alias("fault")).filter("fault IS NOT NULL")


def report_faults(reports: DataFrame, aspects: DataFrame, members: DataFrame) -> DataFrame:
    """report_id, fault: reports whose sample is not the number of their members, with an aspect of another app, or of more
    reviews than the sample."""
    n = members.groupBy("report_id").agg(F.count("*").alias("members"))
    size = reports.join(n, "report_id", "left").filter(F.col("sample_size") != F.coalesce("members", F.lit(0))).select("report_id", F.lit("sample is not the members").alias("fault"))
    own = aspects.select("report_id", F.col("app_id").alias("of_app"), "n_reviews").join(reports.select("report_id", "app_id", "sample_size"), "report_id")
    other = own.filter("of_app <> app_id").select("report_id", F.lit("aspect of another app").alias("fault"))
    return size.unionByName(other).unionByName(own.filter("n_reviews > sample_size").select("report_id", F.lit("more reviews than the sample").alias("fault"))).distinct()


def span_faults(prose: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Spans (key, start, end, span) whose text does not stand in the prose where they say: key, start."""
    rows = spans.join(prose.select(key, "text"), key)
    return rows.filter(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) != F.col("span")).select(key, "start")


def long_metrics(runs: DataFrame) -> DataFrame:
    """Runs with a struct of metrics as rows: run_id, metric, value."""
    names = runs.schema["metrics"].dataType.names
    return runs.select("run_id", F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(f"metrics.{n}").cast("double").alias("value")) for n in names)))).filter("value IS NOT NULL")


def gathered_metrics(metrics: DataFrame) -> DataFrame:
    """run_id, metrics as JSON, sorted by name."""
    pairs = F.array_sort(F.collect_list(F.struct("metric", "value")))
    return metrics.groupBy("run_id").agg(F.to_json(F.map_from_entries(pairs)).alias("metrics"))


def fingerprint(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, digest: the sha256 of each row's other columns as JSON with sorted names; nulls are written."""
    columns = sorted(c for c in rows.columns if c not in keys)
    return rows.select(*keys, F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias("digest"))


def regrouped(labels: DataFrame, apps: DataFrame) -> DataFrame:
    """Labels by app; those of reviews that no app has are an error's matter: app_id null."""
    return labels.join(apps.select("review_id", "app_id"), "review_id", "left").groupBy("app_id", "aspect").agg(F.count_distinct("review_id").alias("n"))
