"""Where streams keep their checkpoints, and bounded runs of a stream into a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; only a local master may do without the setting."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = f"{tempfile.gettempdir()}/hearsay-streams"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keyed_state(spark: SparkSession) -> None:
    """State with timers and several variables a key needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def to_table(stream: DataFrame, table: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Works through all that is there, appends it to a Parquet table, and reads the table. What an earlier run with the same
    checkpoint has written is not written again."""
    query = stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(table)


def replayed(rows: DataFrame, tick: dict, at: str = "at") -> DataFrame:
    """A finished table as a stream: the rows, and a tick two days after the last of them, which brings the watermark past all.

    tick: the values of its row; its other columns are null."""
    spark, where = rows.sparkSession, folder(rows.sparkSession, "replay")
    rows.write.parquet(where)
    kept = spark.read.schema(rows.schema).parquet(where)
    end = kept.agg((F.max(at) + F.expr("INTERVAL 2 DAYS")).alias(at)).filter(F.col(at).isNotNull())
    values = [F.col(at) if f.name == at else F.lit(tick.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema]
    end.select(*values).write.mode("append").parquet(where)
    return spark.readStream.schema(rows.schema).parquet(where)
