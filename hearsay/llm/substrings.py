"""Removal of passages that repeat (operator 6).

A window is ``window`` consecutive words of one document. A word goes if a window covers it whose word sequence also
starts anywhere else, in another document or in the same one.

Method: level-wise doubling. Windows of about a quarter of the length come first; only those that repeat are extended
to half the length, and only those that repeat again to the whole length, until no candidates are left. At the first
level it is enough to look at one short window of each long one: the one of the smallest hash (of equal ones the
leftmost), since equal long windows choose equal short ones. The long windows that choose the same occurrence form one
block; blocks are what is counted, so exact copies, however many, fold to one row before any window is looked at:

1. blocks whose short window is nowhere else are dropped;
2. if all blocks of a short window are equal, all their words go;
3. else one block of each kind stands for its equals, with their number: its half-length windows are counted, and the
   whole windows around those that repeat.

Hashes are 64 bits; blocks and windows are matched on two of them at once. The hot rows are those of many copies; they
are pre-aggregated in the map tasks before any exchange, and joined back by joins that adaptive execution can split.

Edge cases: null and empty texts, and texts with fewer words than a window, lose nothing; a very long text is read whole by
one task; of equally small hashes the leftmost window is chosen; two rows of one doc_id, even equal ones, are two
documents; an empty table gives an empty one; extra columns are kept, whatever their names, but n_words, n_removed and
kept are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearsay.llm import kernels, shared


def _blocks(run: kernels.Run, window: int, short: int):
    """Of each block of a run: its document, first and last window start (within the run), its short window's place
    and hash, and the hash of all its words."""
    starts, ends, bounds, buf = kernels.words(run)
    words = kernels.span_hashes(buf, starts, ends)
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return words, bounds, none, none, none, none, none, none
    grams = kernels.windows(words, short)
    chosen = kernels.sliding_argmin(grams, window - short + 1)
    docs = np.repeat(np.arange(len(run)), np.diff(bounds))[: len(chosen)]
    good = np.arange(len(chosen)) + window <= bounds[1:][docs]
    at = np.flatnonzero(good)
    if not len(at):
        return words, bounds, none, none, none, none, none, none
    picked = chosen[at]
    edge = np.flatnonzero(np.concatenate([[True], (picked[1:] != picked[:-1]) | (docs[at][1:] != docs[at][:-1])]))
    first = at[edge]
    last = at[np.append(edge[1:], len(at)) - 1]
    place = picked[edge]
    whole = kernels.range_hashes(words, first, last + window) ^ kernels.mix((place - first).astype(np.uint64))
    return words, bounds, docs[first], first, last, place, grams[place], whole


def blocks(docs: DataFrame, window: int, short: int, key: str) -> DataFrame:
    """key, first, last, place (word places within the document), gram, block (hashes)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            for run in kernels.runs(batch.column("text")):
                _, bounds, doc, first, last, place, gram, whole = _blocks(run, window, short)
                if len(doc):
                    base = bounds[doc]
                    yield pa.RecordBatch.from_pydict({
                        key: keys[run.first + doc], "first": (first - base).astype(np.int32), "last": (last - base).astype(np.int32),
                        "place": (place - base).astype(np.int32), "gram": gram.view(np.int64), "block": whole.view(np.int64),
                    })

    return docs.select(key, "text").mapInArrow(work, f"{key} long, first int, last int, place int, gram long, block long")


def _levels(docs: DataFrame, kinds: DataFrame, window: int, short: int, half: int, key: str) -> DataFrame:
    """For one block of each kind, the hashes of its longer windows: those of the half length that start or end with its
    short window, and those of the whole length, from the first start to the last."""
    of = kinds.groupBy(key).agg(F.collect_list(F.struct("gram", "block", "n", "first", "last", "place")).alias("kinds"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds_ = batch.column("kinds")
            for run in kernels.runs(batch.column("text")):
                starts, ends, bounds, buf = kernels.words(run)
                words = kernels.span_hashes(buf, starts, ends)
                mine = kinds_.slice(run.first, len(run))
                sizes = mine.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                rows = mine.flatten()
                base = np.repeat(bounds[:-1], sizes)
                ends_ = np.repeat(bounds[1:], sizes)
                first, last, place = (rows.field(c).to_numpy(zero_copy_only=False).astype(np.int64) + base for c in ("first", "last", "place"))
                halves, wholes = kernels.windows(words, half), kernels.windows(words, window)
                right = place + half <= ends_  # a half-length window that starts with the short one
                left = place + short - half >= base
                out_right = np.where(right, halves[np.minimum(place, len(halves) - 1)].view(np.int64), 0)
                out_left = np.where(left, halves[np.maximum(place + short - half, 0)].view(np.int64), 0)
                counts = last - first + 1
                sums = np.concatenate([[0], np.cumsum(counts)])
                at = np.repeat(first - sums[:-1], counts) + np.arange(sums[-1])
                for a in range(0, len(rows), 4096):
                    z = min(a + 4096, len(rows))
                    part = rows.slice(a, z - a)
                    hashes = pa.ListArray.from_arrays(pa.array((sums[a : z + 1] - sums[a]).astype(np.int32)), pa.array(wholes[at[sums[a] : sums[z]]].view(np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [part.field("gram"), part.field("block"), part.field("n"), pa.array((place - first)[a:z].astype(np.int32)),
                         pa.array(out_right[a:z], mask=~right[a:z]), pa.array(out_left[a:z], mask=~left[a:z]), hashes],
                        names=["gram", "block", "n", "offset", "right", "left", "wholes"],
                    )

    schema = "gram long, block long, n long, offset int, right long, left long, wholes array<bigint>"
    return docs.select(key, "text").join(of, key).select("text", "kinds").mapInArrow(work, schema)


def covered(docs: DataFrame, window: int = 35, key: str = "_hearsay_key") -> DataFrame:
    """Where repeated windows start: key and ranges, an array of (first, last) window starts of the document.

    docs has the columns key (a hash of the row) and text.
    """
    short = max(1, -(-window // 4))
    half = min(window, 2 * short)
    found = shared.written(blocks(docs, window, short, key), "blocks")
    grams = found.groupBy("gram").agg(F.count("*").alias("n"), F.min("block").alias("low"), F.max("block").alias("high"))
    grams = grams.filter("n > 1").select("gram", (F.col("low") == F.col("high")).alias("alike"))
    repeated = shared.written(found.join(grams, "gram"), "repeated")

    one = F.struct(key, "first", "last", "place")
    kinds = repeated.filter("NOT alike").groupBy("gram", "block").agg(F.count("*").alias("n"), F.min(one).alias("one")).select("gram", "block", "n", "one.*")
    levels = shared.written(_levels(docs, kinds, window, short, half, key), "levels")
    sides = levels.select("gram", "block", "n", F.explode(F.array_compact(F.array("right", "left"))).alias("half"))
    again = sides.groupBy("gram", "half").agg(F.sum("n").alias("n")).filter("n > 1").select("gram", "half")
    # a whole window contains the half-length one to the right of the short one if that fits in it, else the one to the left
    fits = F.col("offset") - F.col("i") + half <= window
    every = levels.select("gram", "block", "n", "offset", "right", "left", F.posexplode("wholes").alias("i", "whole"))
    every = every.select("gram", "block", "n", "i", "whole", F.when(fits, F.col("right")).otherwise(F.col("left")).alias("half"))
    candidates = every.join(again, ["gram", "half"], "left_semi")
    whole = candidates.groupBy("gram", "whole").agg(F.sum("n").alias("n")).filter("n > 1").select("gram", "whole")
    starts = candidates.join(whole, ["gram", "whole"], "left_semi").groupBy("gram", "block").agg(F.collect_set("i").alias("starts"))

    alike = repeated.filter("alike").select(key, F.struct("first", "last").alias("range"))
    partly = repeated.filter("NOT alike").join(starts, ["gram", "block"]).select(
        key, F.explode(F.transform("starts", lambda i: F.struct((F.col("first") + i).alias("first"), (F.col("first") + i).alias("last")))).alias("range")
    )
    # equal rows have one key and the same ranges: each counts once
    return alike.unionAll(partly).groupBy(key).agg(F.collect_set("range").alias("ranges"))


def remove_repeats(docs: DataFrame, window: int = 35, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_words, n_removed and kept: the words of ``text`` that no repeated window covers, joined by one space."""
    key, held = "_hearsay_key", "_hearsay_ranges"
    keyed = docs.withColumn(key, F.xxhash64(doc_id, text))
    ranges = covered(keyed.select(key, F.col(text).alias("text")), window, key).withColumnRenamed("ranges", held)
    kept = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept")]
    schema = T.StructType([f for f in docs.schema.fields if f.name in kept])
    schema = schema.add("n_words", T.LongType()).add("n_removed", T.LongType()).add("kept", T.StringType())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ranges = batch.column(held)
            for run in kernels.runs(batch.column(text)):
                starts, ends, bounds, buf = kernels.words(run)
                mine = all_ranges.slice(run.first, len(run))
                sizes = mine.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                rows = mine.flatten()
                base = np.repeat(bounds[:-1], sizes)
                change = np.zeros(len(starts) + 1, np.int64)
                np.add.at(change, rows.field("first").to_numpy(zero_copy_only=False) + base, 1)
                np.add.at(change, rows.field("last").to_numpy(zero_copy_only=False) + base + window, -1)
                keep = np.cumsum(change[:-1]) == 0
                gone = np.concatenate([[0], np.cumsum(~keep)])
                here = batch.slice(run.first, len(run))
                yield pa.RecordBatch.from_arrays(
                    [*(here.column(c) for c in kept), pa.array(np.diff(bounds)), pa.array(np.diff(gone[bounds])), kernels.kept_text(run, starts, ends, bounds, keep)],
                    names=[*kept, "n_words", "n_removed", "kept"],
                )

    return keyed.join(ranges, key, "left").select(*dict.fromkeys([*kept, text]), held).mapInArrow(work, schema)
