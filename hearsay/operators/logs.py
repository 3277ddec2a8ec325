"""Event logs of jobs as frames: what a reader who replays a log sees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frames(log: DataFrame, heartbeat_s: float) -> DataFrame:
    """Frames of a log (job_id, index, at, event, data): job_id, place (from 0), id, event, data.

    Each index once, in order; before a row a heartbeat for each ``heartbeat_s`` of silence, and a gap where indexes lack. The row
    ``end`` is the last frame of its job and has no id. Of rows of equal index the first by (at, event, data) counts.
    """
    job = Window.partitionBy("job_id").orderBy("index")
    first = Window.partitionBy("job_id", "index").orderBy("at", "event", "data")
    once = log.withColumn("_copy", F.row_number().over(first)).filter("_copy = 1")
    beat = round(heartbeat_s * 1_000_000)
    us = F.unix_micros(F.col("at").cast("timestamp"))
    rows = once.select(
        "job_id", "index", "event", "data", (F.col("index") - F.coalesce(F.lag("index").over(job), F.lit(-1)) - 1).alias("lacking"),
        F.greatest(F.lit(0), F.floor((us - F.lag(us).over(job) - 1) / beat)).alias("beats"),
        F.coalesce(F.max((F.col("event") == "end").cast("int")).over(job.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("over"),
    ).filter("over = 0")
    frame = lambda id_, event, data: F.struct(id_.cast("long").alias("id"), event.alias("event"), data.alias("data"))
    nothing = F.array().cast("array<struct<id: bigint, event: string, data: string>>")
    none = F.lit(None).cast("string")
    gap = F.when(F.col("lacking") > 0, F.array(frame(none, F.lit("gap"), F.concat_ws("..", F.col("index") - F.col("lacking"), F.col("index") - 1)))).otherwise(nothing)
    beats = F.coalesce(F.array_repeat(frame(none, F.lit("heartbeat"), none), F.col("beats").cast("int")), nothing)
    own = F.array(frame(F.when(F.col("event") != "end", F.col("index")), F.col("event"), F.col("data")))
    shown = rows.select("job_id", "index", F.posexplode(F.concat(gap, beats, own)).alias("k", "frame"))
    place = F.row_number().over(Window.partitionBy("job_id").orderBy("index", "k")) - 1
    return shown.select("job_id", place.alias("place"), "frame.*")
