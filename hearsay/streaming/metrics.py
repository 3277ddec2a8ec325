"""A tee for what a run tells about itself: metrics counted while rows go by, of batches and of micro-batches, as rows of one table."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

METRICS = "stage string, batch long, metric string, value double"


class Tee(StreamingQueryListener):
    """Collects metrics under the names of stages. Rows go on unchanged; nothing is computed twice for a count.

    counted() marks a batch's DataFrame, observed() a stream; rows() is what has come so far, and write() appends it to a table. A
    stream's metrics come with each micro-batch that has ended, once the listener has been added to the session."""

    def __init__(self, spark: SparkSession):
        self.spark, self._lock, self._rows, self._open = spark, threading.Lock(), [], []

    def counted(self, df: DataFrame, stage: str, *metrics: Column) -> DataFrame:
        """df, whose first action tells its rows and metrics (named columns)."""
        seen = Observation(f"{stage}-{len(self._open)}")
        self._open.append((stage, seen))
        return df.observe(seen, F.count("*").alias("rows"), *metrics)

    def observed(self, stream: DataFrame, stage: str, *metrics: Column) -> DataFrame:
        return stream.observe(f"tee:{stage}", F.count("*").alias("rows"), *metrics)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        for name, row in (progress.observedMetrics or {}).items():
            if name.startswith("tee:"):
                with self._lock:
                    self._rows += [(name[4:], progress.batchId, k, float(v)) for k, v in row.asDict().items() if v is not None]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def rows(self) -> DataFrame:
        """METRICS of streams, and of batches whose action is over (asking for one that has not run waits for it)."""
        for stage, seen in self._open:
            self._rows += [(stage, None, k, float(v)) for k, v in seen.get.items() if v is not None]
        self._open = []
        with self._lock:
            return self.spark.createDataFrame(list(self._rows), METRICS)

    def write(self, table: str) -> None:
        self.rows().write.mode("append").parquet(table)
