"""Token-id files compressed by a grammar (operator 3).

Method: Re-Pair. In each shard the most frequent adjacent id pairs are replaced by new symbols (nonterminals), again and
again until no pair is frequent; the file keeps the rules, each rule's expansion length and each document's place, so
that a single document or token range is decoded without expanding the rest of its shard.

A round replaces all frequent pairs at once: of overlapping occurrences the one of the more frequent pair wins, of equal
pairs the left one. Symbols are linked where they stand, and a round looks only at pairs next to the last round's
replacements, so later rounds cost little. Pairs never cross the end of a document. Shards are runs of documents in
ascending doc_id order (nulls first, then by a hash of the text) of about ``shard_tokens`` ids; a longer document is a
shard of its own. The only shuffle deals whole texts by ranges. Files are written by Spark's Parquet writer, one row a
shard, so a lost executor only repeats its tasks.

Edge cases: a null or empty text has only the end id; rows of an equal doc_id, and equal rows, keep all; a very long text
is encoded whole in one task; extra columns are left out; an empty table gives files without rows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearsay.llm import kernels
from hearsay.llm.bpe import byte_alphabet

#: part: place of the task in doc_id order; shard: place in the part; start: ids of the part before this shard.
#: rule_left, rule_right, rule_length: little-endian uint32 (length uint64) for symbols base, base + 1, ...
#: symbols: little-endian uint32; doc_symbols, doc_tokens: how many of each a document has.
SHARD_SCHEMA = """part int, shard int, start long, base long, n_rules long, rule_left binary, rule_right binary,
rule_length binary, symbols binary, doc_ids array<bigint>, doc_symbols array<int>, doc_tokens array<bigint>"""


def _sorted_pairs(left: np.ndarray, right: np.ndarray, places: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of symbols under ``top`` as one number each, sorted, and their places; sorted together where both fit in 63 bits."""
    pairs = left * (top + 1) + right
    shift = int(places[-1]).bit_length() if len(places) else 0
    if 2 * (top + 1).bit_length() + shift > 63:
        order = np.argsort(pairs)
        return pairs[order], places[order]
    both = np.sort((pairs << shift) | places)
    return both >> shift, both & ((1 << shift) - 1)


def compress(ids: np.ndarray, ends: np.ndarray, base: int, least: int):
    """Symbols, rules (left, right) and each document's number of symbols.

    ids: int64 token ids under base; ends: index after each document's last id.
    """
    n = len(ids)
    # symbols stay where they are, linked to those before and after them in their document; place n stands for none
    seq = np.append(ids, -1).astype(np.int64)
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    after[n] = n
    after[ends[ends > 0] - 1] = n
    before[np.append(0, ends[ends < n])] = n
    gone = np.zeros(n + 1, bool)
    ranks = np.full(n + 1, n + 1, np.int32)
    lefts, rights, top = [], [], base
    places = np.flatnonzero(after[:n] < n)  # where pairs start that can be frequent: at first all
    while len(places) >= least:
        pairs, at = _sorted_pairs(seq[places], seq[after[places]], places, top)
        edge = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        counts = np.diff(np.append(edge, len(pairs)))
        often = np.flatnonzero(counts >= least)
        if not len(often):
            break
        keys, numbers = pairs[edge[often]], counts[often]
        by_rank = np.argsort(-numbers, kind="stable")
        rank = np.empty(len(keys), np.int32)
        rank[by_rank] = np.arange(len(keys))
        starts = np.repeat(edge[often] - np.concatenate([[0], np.cumsum(numbers)[:-1]]), numbers) + np.arange(numbers.sum())
        at = at[starts].astype(np.int32)  # of frequent pairs only
        mine = np.repeat(rank, numbers)
        ranks[at] = mine
        take = (mine < ranks[before[at]]) & (mine <= ranks[after[at]])
        ranks[at] = n + 1
        first = at[take]
        second = after[first]
        seen = np.zeros(len(keys), bool)
        seen[mine[take]] = True
        used = np.flatnonzero(seen)
        number = (np.cumsum(seen) - 1)[mine[take]]
        made = keys[by_rank[used]]
        lefts.append(made // (top + 1))
        rights.append(made % (top + 1))
        seq[first] = top + number
        top += len(used)
        gone[second] = True
        follows = after[second]
        after[first] = follows
        before[follows] = first
        # a pair can have become frequent only with a new symbol; one that lost its place to another waits
        lost = at[~take]
        places = np.sort(np.concatenate([first, before[first], lost[~gone[lost]]]))
        places = places[np.append(True, places[1:] != places[:-1]) & (after[places] < n)]
    rules = (np.concatenate(lefts), np.concatenate(rights)) if lefts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    sums = np.concatenate([[0], np.cumsum(~gone[:n])])
    bounds = sums[np.concatenate([[0], ends])]
    return seq[:n][~gone[:n]], rules, np.diff(bounds)


def rule_lengths(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule stands for."""
    lengths = np.ones(len(left), np.int64)
    for i, (a, b) in enumerate(zip((left - base).tolist(), (right - base).tolist(), strict=True)):
        lengths[i] = (lengths[a] if a >= 0 else 1) + (lengths[b] if b >= 0 else 1)
    return lengths


def expand(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """The ids that a few symbols stand for, level by level."""
    seq = symbols.astype(np.int64)
    while True:
        high = seq >= base
        if not high.any():
            return seq
        out = np.empty(len(seq) + int(high.sum()), np.int64)
        at = np.arange(len(seq)) + np.concatenate([[0], np.cumsum(high)[:-1]])
        out[at[~high]] = seq[~high]
        out[at[high]] = left[seq[high] - base]
        out[at[high] + 1] = right[seq[high] - base]
        seq = out


def expand_all(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """The ids of a whole shard: each rule is expanded once, into at most as many ids as the longest document has."""
    rules: list[list[int]] = []
    for a, b in zip((left - base).tolist(), (right - base).tolist(), strict=True):
        rules.append((rules[a] if a >= 0 else [a + base]) + (rules[b] if b >= 0 else [b + base]))
    lengths = np.fromiter(map(len, rules), np.int64, len(rules))
    flat = np.fromiter(chain.from_iterable(rules), np.int64, int(lengths.sum()))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    # plain ids follow the rules' ids in one table that is gathered from
    high = symbols >= base
    rule = np.where(high, symbols - base, 0)
    sizes = np.ones(len(symbols), np.int64)
    sizes[high] = lengths[rule[high]]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    out = np.empty(total, np.int64)
    out[(ends - sizes)[~high]] = symbols[~high]
    first, n = (ends - sizes)[high], sizes[high]
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(first, n) + step] = flat[np.repeat(starts[rule[high]], n) + step]
    return out


class Shard:
    """One row of the files, for random access."""

    def __init__(self, row):
        self.base = row["base"]
        self.left = np.frombuffer(row["rule_left"], "<u4").astype(np.int64)
        self.right = np.frombuffer(row["rule_right"], "<u4").astype(np.int64)
        self.lengths = np.frombuffer(row["rule_length"], "<u8").astype(np.int64)
        self.symbols = np.frombuffer(row["symbols"], "<u4").astype(np.int64)
        self.doc_symbols = np.concatenate([[0], np.cumsum(np.asarray(row["doc_symbols"], np.int64))])

    def document(self, place: int) -> np.ndarray:
        """Ids of the document at a place of the shard; no other document is expanded."""
        a, b = self.doc_symbols[place], self.doc_symbols[place + 1]
        return expand(self.symbols[a:b], self.left, self.right, self.base)

    def tokens(self, first: int, last: int) -> np.ndarray:
        """Ids first to last (excluded) of the shard; only the symbols that cover them are expanded."""
        sizes = np.ones(len(self.symbols), np.int64)
        high = self.symbols >= self.base
        sizes[high] = self.lengths[self.symbols[high] - self.base]
        ends = np.cumsum(sizes)
        a, b = int(np.searchsorted(ends, first, "right")), int(np.searchsorted(ends, last, "left")) + 1
        before = int(ends[a - 1]) if a else 0
        return expand(self.symbols[a:b], self.left, self.right, self.base)[first - before : last - before]


def _loaded(path: str) -> tuple[int, kernels.IdCache]:
    """The tokenizer's ids end here; and its cache of chunks. One for each worker process."""

    def load():
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        letters = byte_alphabet()
        model = tokenizer.model

        tokens, space = model.tokenize, letters[0x20]
        # Latin letters, with or without one space before them, are cut no further: the library's model alone does them
        english, latin = re.compile(rb" ?[A-Za-z]+").fullmatch, re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+").fullmatch

        def make(chunks: list[bytes]) -> list[list[int]]:
            out, others = [], []
            for chunk in chunks:
                if english(chunk):
                    out.append([t.id for t in tokens(chunk.decode().replace(" ", space))])
                    continue
                text = chunk.decode("utf-8", "replace")
                if latin(text):
                    out.append([t.id for t in tokens("".join([letters[b] for b in chunk]))])
                else:
                    others.append((len(out), text))
                    out.append([])
            for (i, _), found in zip(others, tokenizer.encode_batch_fast([t for _, t in others], add_special_tokens=False), strict=True):
                out[i] = found.ids
            return out

        return tokenizer.get_vocab_size(with_added_tokens=True), kernels.IdCache(make)

    return kernels.worker_state(("token files", path), load)


def pack(
    docs: DataFrame, path: str, end_id: int = 2, partitions: int | None = None, shard_tokens: int = 1 << 20, least: int = 8,
) -> DataFrame:
    """Rows of SHARD_SCHEMA for the whole texts of docs (doc_id, text), in ascending doc_id order.

    path: the tokenizer's file. A pair is frequent if a shard has it ``least`` times. partitions: as many as shuffles have,
    if not given.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        base, cache = _loaded(path)
        part, shard, start = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        count = 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, start, held, count
            ids = np.concatenate([h[0] for h in held])
            tokens = np.concatenate([h[1] for h in held])
            names = pa.concat_arrays([h[2] for h in held])
            seq, (left, right), doc_symbols = compress(ids, np.cumsum(tokens), base, least)
            row = {
                "part": part, "shard": shard, "start": start, "base": base, "n_rules": len(left),
                "rule_left": left.astype("<u4").tobytes(), "rule_right": right.astype("<u4").tobytes(),
                "rule_length": rule_lengths(left, right, base).astype("<u8").tobytes(), "symbols": seq.astype("<u4").tobytes(),
                "doc_ids": names, "doc_symbols": pa.array(doc_symbols.astype(np.int32)), "doc_tokens": pa.array(tokens.astype(np.int64)),
            }
            shard, start, held, count = shard + 1, start + len(ids), [], 0
            lists = {k: pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), row.pop(k)) for k in ("doc_ids", "doc_symbols", "doc_tokens")}
            return pa.RecordBatch.from_arrays([lists[f.name] if f.name in lists else pa.array([row[f.name]], f.type) for f in arrow], schema=arrow)

        for batch in batches:
            names = batch.column("doc_id")
            for run in kernels.runs(batch.column("text")):
                flat, bounds = cache.ids(run)
                tokens = np.diff(bounds) + 1
                ids = np.full(len(flat) + len(run), end_id, np.int64)
                ids[np.arange(len(flat)) + np.repeat(np.arange(len(run)), np.diff(bounds))] = flat
                held.append((ids, tokens, names.slice(run.first, len(run))))
                count += len(ids)
                if count >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    arrow = pa.schema([
        ("part", pa.int32()), ("shard", pa.int32()), ("start", pa.int64()), ("base", pa.int64()), ("n_rules", pa.int64()),
        ("rule_left", pa.binary()), ("rule_right", pa.binary()), ("rule_length", pa.binary()), ("symbols", pa.binary()),
        ("doc_ids", pa.list_(pa.int64())), ("doc_symbols", pa.list_(pa.int32())), ("doc_tokens", pa.list_(pa.int64())),
    ])
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]  # rows of one id, or of none, can be in several parts
    rows = docs.select("doc_id", "text")
    dealt = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order).mapInArrow(work, SHARD_SCHEMA)


def write(shards: DataFrame, folder: str) -> None:
    shards.write.parquet(folder)


def unpack(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids (uint32 little-endian)."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(folder)
    # one row for each task of the writer: the window's only group is that small
    parts = shards.groupBy("part").agg(F.sum(F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("part", "start", "base")}
                raw = lambda c, kind: np.frombuffer(batch.column(c)[i].as_buffer(), kind).astype(np.int64)  # noqa: B023, E731
                ids = expand_all(raw("symbols", "<u4"), raw("rule_left", "<u4"), raw("rule_right", "<u4"), row["base"]).astype("<u4")
                tokens = batch.column("doc_tokens")[i].values.to_numpy()
                names = batch.column("doc_ids")[i].values
                ends = np.cumsum(tokens)
                starts = ends - tokens
                for a in range(0, len(ends), 512):
                    z = min(a + 512, len(ends))
                    low = int(starts[a])
                    offsets = np.append(starts[a:z] - low, ends[z - 1] - low) * 4
                    data = ids[low : int(ends[z - 1])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(z - a, row["part"], np.int32)), names.slice(a, z - a), pa.array(starts[a:z] + row["start"]), pa.array(tokens[a:z]),
                         pa.BinaryArray.from_buffers(pa.binary(), z - a, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])],
                        names=["part", "doc_id", "start", "n_tokens", "ids"],
                    )

    docs = shards.mapInArrow(work, "part int, doc_id long, start long, n_tokens long, ids binary")
    return docs.join(F.broadcast(parts), "part").select("doc_id", (F.col("start") + F.col("part_start")).alias("start"), "n_tokens", "ids")

