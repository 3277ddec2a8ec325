"""Streams over the event table: windowed counts with a watermark, and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, from its start; new files follow."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def daily_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events and mean value per type and day; rows later than the watermark are dropped, closed days are emitted once."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(
        F.col("w.start").alias("day"), "event_type", "n", "mean_value"
    )


def deduplicated(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Each event_id once, as long as its copies come within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_once(stream: DataFrame, table: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Works through all that is there and returns the in-memory table of results; for tests and backfills."""
    query = stream.writeStream.format("memory").queryName(table).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(table)
