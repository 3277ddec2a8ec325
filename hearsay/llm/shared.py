"""Tables cut from their lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir. A local master may do without the setting, as in tests; a cluster may not,
    since its machines do not share their temporary folders."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = f"{tempfile.gettempdir()}/hearsay-shared"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint of df: computed once, kept in the shared folder, dropped when nothing refers to it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoint"))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back; for wide rows, whose columns are then pruned."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def dropped(*tables: DataFrame) -> None:
    """Deletes what ``written`` has made, once nothing reads it any more."""
    for table in tables:
        jvm = table.sparkSession._jvm
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def likely(df: DataFrame, key: str, keys: DataFrame, most_bits: int = 1 << 26) -> DataFrame:
    """Rows of df whose key (a hash) is among keys (one column), and few others: for wide rows, ahead of a join that drops these.
    It goes by a table of bits, eight or more for a key, 8 MB at most; beyond that more rows pass."""
    keys = cut(keys.toDF("key"))
    bits = min(most_bits, max(1 << 12, 1 << int(8 * keys.count()).bit_length()))
    place = F.pmod("key", F.lit(bits))
    words = keys.groupBy(F.floor(place / 64).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(key, {bits}) % 64 as int))")).alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    sent = df.sparkSession.sparkContext.broadcast(table)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(key).to_numpy().view(np.uint64) & np.uint64(bits - 1)
            passed = sent.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)
            yield batch.filter(pa.array(passed.astype(bool)))

    return df.mapInArrow(work, df.schema)


def small_batches(spark: SparkSession, rows: int = 500, size: str = "4m") -> None:
    """From now on Arrow batches between Spark and its Python workers hold no more rows or bytes than this, so that texts in flight
    are few on both sides, however long they are. A session that has smaller ones keeps them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
