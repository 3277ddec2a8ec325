"""Labelling while pages still come: micro-batches of members are asked about as they land, then what failed is asked again.

Three bounded passes: ``initial`` in batches of ``size``, one for each micro-batch of the stream; ``rebatch``, the failures of all of
them in new batches; ``isolate``, what failed again, alone. What fails alone has failed for good.

Each pass (of each micro-batch) writes what it asked, and the mentions, failures and repairs that came of it, to a folder of its
own, and then one entry of the attempt log, which appears whole or not at all. A pass that has an entry is not asked again, so a run that
was stopped anywhere goes on where it was, and what it had bought is kept. Folders without an entry count for nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearsay.operators import replies
from hearsay.operators.selection import numbered
from hearsay.sources import store as st

PASSES = ("initial", "rebatch", "isolate")
ASKED = "review_id string, batch long, idx long"


class Passes:
    """answer: rows (review_id, text, batch, idx, size) of a pass -> replies (batch, size, reply). known: review_ids that an earlier
    run has labelled, which are not asked about again."""

    def __init__(self, spark: SparkSession, folder: str, answer: Callable[[DataFrame], DataFrame], index: DataFrame, size: int = 10, known: DataFrame | None = None):
        self.spark, self.folder, self.answer, self.index, self.size, self.known = spark, folder.rstrip("/"), answer, index, size, known

    def _entries(self) -> dict[str, str]:
        files, log = st._files(self.spark, f"{self.folder}/_log")
        if not files.exists(log):
            return {}
        names = [s.getPath().getName() for s in files.listStatus(log)]
        return {n.removesuffix(".json"): json.loads(self.spark.read.text(f"{self.folder}/_log/{n}", wholetext=True).first()[0])["data"] for n in sorted(names) if n.endswith(".json") and not n.startswith(".")}

    def _table(self, name: str, schema: str, prefix: str = "") -> DataFrame:
        """What was asked, or one kind of what was found, of all entries or of those of a pass."""
        entries = [where for entry, where in self._entries().items() if entry.startswith(prefix)]
        empty = self.spark.createDataFrame([], schema)
        if not entries:
            return empty
        if name == "asked":
            return self.spark.read.schema(empty.schema).parquet(*(f"{self.folder}/{w}/asked" for w in entries))
        files, _ = st._files(self.spark, self.folder)
        there = [p for w in entries if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p := f"{self.folder}/{w}/found/kind={name}"))]
        return self.spark.read.schema(empty.schema).parquet(*there) if there else empty

    def _attempt(self, entry: str, members: DataFrame, size: int) -> None:
        """Asks about members (review_id, text) in batches, in the order of their ids, and logs what came of it."""
        if entry in self._entries():
            return
        where = f"data/{entry}-{uuid.uuid4().hex}"
        at = f"{self.folder}/{where}"
        placed = numbered(members.select("review_id", "text").dropDuplicates(["review_id"]), ["review_id"], "place")
        asked = placed.select("review_id", "text", F.floor(F.col("place") / size).cast("long").alias("batch"), (F.col("place") % size).cast("long").alias("idx"))
        asked.write.parquet(f"{at}/asked")
        asked = self.spark.read.schema(asked.schema).parquet(f"{at}/asked")
        sizes = asked.groupBy("batch").agg(F.count("*").cast("int").alias("size"))
        self.answer(asked.join(sizes, "batch")).write.parquet(f"{at}/replies")
        got = self.spark.read.schema("batch long, size int, reply string").parquet(f"{at}/replies")
        # a batch of which no reply came back has failed as a whole
        got = sizes.join(got.select("batch", "reply"), "batch", "left").select("batch", "size", F.coalesce("reply", F.lit("")).alias("reply"))
        names = asked.select("batch", "idx", "review_id")
        # replies are read once for all that is found; a text that any reply fails has nothing but its failure
        found = replies.found(got, asked.select("batch", "idx", "text"), self.index).filter("idx IS NOT NULL")
        found = found.withColumn("_bad", F.min("reason").over(Window.partitionBy("batch", "idx"))).filter("_bad IS NULL OR reason = _bad").drop("_bad")
        found.join(names, ["batch", "idx"]).drop("batch", "idx").write.partitionBy("kind").parquet(f"{at}/found")  # one job: its parts share their shuffles
        st.publish(self.spark, f"{self.folder}/_log/{entry}.json", json.dumps({"data": where}))

    def follow(self, members: DataFrame, checkpoint: str) -> None:
        """The initial pass over a stream of members (review_id, text), until no more is there. A member that came before is not asked again."""

        def one(rows: DataFrame, number: int) -> None:
            fresh = rows.join(self._table("asked", ASKED, "initial").select("review_id"), "review_id", "left_anti")
            if self.known is not None:
                fresh = fresh.join(self.known.select("review_id"), "review_id", "left_anti")
            self._attempt(f"initial-{number:012d}", fresh, self.size)

        query = members.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()

    def owed(self, after: str) -> DataFrame:
        """What failed in a pass, with its text."""
        failed = self._table("failures", "review_id string, reason string", after).select("review_id").distinct()
        return self._table("asked", ASKED + ", text string", "initial").select("review_id", "text").join(failed, "review_id", "left_semi")

    def finish(self) -> None:
        """The two passes over what failed; call it once the stream has ended."""
        self._attempt("rebatch", self.owed("initial"), self.size)
        self._attempt("isolate", self.owed("rebatch"), 1)

    def mentions(self) -> DataFrame:
        return self._table("mentions", "review_id string, aspect string, slot string, sentiment string, evidence string")

    def failures(self) -> DataFrame:
        """What has failed for good: review_id, reason."""
        return self._table("failures", "review_id string, reason string", "isolate")

    def outcomes(self) -> DataFrame:
        """review_id, attempt (the pass that labelled it; isolate if none did), ok."""
        found = None
        for k, name in enumerate(PASSES):
            asked = self._table("asked", ASKED, name).select("review_id")
            bad = self._table("failures", "review_id string, reason string", name).select("review_id", F.lit(False).alias("_bad"))
            own = asked.join(bad, "review_id", "left").select("review_id", F.lit(k).alias("attempt"), F.col("_bad").isNull().alias("ok"))
            found = own if found is None else found.unionAll(own)
        last = found.groupBy("review_id").agg(F.max("attempt").alias("k"), F.max_by("ok", "attempt").alias("ok"))
        return last.select("review_id", F.element_at(F.array(*map(F.lit, PASSES)), F.col("k") + 1).alias("attempt"), "ok")

    def totals(self) -> DataFrame:
        """Counters of the run, one row: members, labelled, failed, rebatched, isolated, mentions, repairs."""
        o = self.outcomes().agg(
            F.count("*").alias("members"), F.count_if("ok").alias("labelled"), F.count_if(~F.col("ok")).alias("failed"),
            F.count_if(F.col("attempt") != "initial").alias("rebatched"), F.count_if(F.col("attempt") == "isolate").alias("isolated"),
        )
        m = self.mentions().agg(F.count("*").alias("mentions"))
        r = self._table("repairs", "review_id string, aspect string, evidence string").agg(F.count("*").alias("repairs"))
        return o.join(m, how="cross").join(r, how="cross")  # one row each
