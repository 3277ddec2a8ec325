"""Packing of examples into training sequences by vector bin packing (operator 12).

Method: a piece of an example is a vector (tokens, one segment, loss-bearing tokens), and so is what a sequence has left. The
piece whose dot product with the sequence's residual is largest, both as shares of the limits, goes in next, among those that
fit in all three; of equal products the kind that has waited longer goes first. When none fits, the piece that fills most of the gap is
cut there. A sequence that can't be filled, since its segments are used up or no piece is left, is cut back to the largest
power of two of tokens, a length that needs no padding, and what was cut off waits for another sequence.

Examples are first cut to what one sequence may hold; a piece that fills a sequence alone is one. The loss-bearing tokens of an
example are its last ``n_loss`` ones (a prompt bears none), so a cut piece knows its own.

A task packs the examples of its partition as they stream by: it holds about WINDOW ids at a time, and always keeps enough of
them for a choice until its input ends. Nothing is shuffled or collected; a task that is repeated packs its rows again. A
sequence's id is the task's number and its place there.

Edge cases: a null or empty text has only the end id; n_loss null or beyond the example counts as all of it; an example without
ids is in no sequence; equal rows, and rows of equal or null id, are examples each; very long texts are cut like others, and
are encoded whole in one task; extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm import kernels
from hearsay.llm.grammar import _loaded

#: Ids that a task holds at a time, and how many of them it keeps for a choice while more come.
WINDOW, KEEP = 1 << 20, 1 << 17


def token_ids(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, ids (int array, with the end id), n_loss: all of them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _, cache = _loaded(path)
        for batch in batches:
            for run in kernels.runs(batch.column("text")):
                flat, bounds = cache.ids(run)
                ids = np.full(len(flat) + len(run), end_id, np.int32)
                ids[np.arange(len(flat)) + np.repeat(np.arange(len(run)), np.diff(bounds))] = flat
                offsets = (bounds + np.arange(len(run) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(run.first, len(run)), lists, pa.array(np.diff(offsets).astype(np.int64))], names=["doc_id", "ids", "n_loss"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, ids array<int>, n_loss long")


class Pool:
    """Pieces that wait, by kind (tokens, loss-bearing tokens)."""

    def __init__(self, limits: tuple[int, int, int]):
        self.limits = limits
        self.kinds: dict[tuple[int, int], int] = {}
        self.waiting: list[list] = []
        self.tokens = self.loss = self.count = np.zeros(0, np.int64)
        self.total = 0

    def put(self, piece: tuple) -> None:
        """piece: (example, start, length, loss)."""
        kind = (piece[2], piece[3])
        at = self.kinds.get(kind)
        if at is None:
            at = self.kinds[kind] = len(self.waiting)
            self.waiting.append([])
            if at == len(self.tokens):
                self.tokens, self.loss, self.count = (np.concatenate([a, np.zeros(max(64, at), np.int64)]) for a in (self.tokens, self.loss, self.count))
            self.tokens[at], self.loss[at] = kind
        self.waiting[at].append(piece)
        self.count[at] += 1
        self.total += piece[2]

    def take(self, at: int) -> tuple:
        piece = self.waiting[at].pop()
        self.count[at] -= 1
        self.total -= piece[2]
        return piece

    def tidy(self) -> None:
        """Kinds in order, most tokens first, without those of which none waits."""
        held = sorted(((k, self.waiting[at]) for k, at in self.kinds.items() if self.waiting[at]), reverse=True)
        self.kinds = {k: i for i, (k, _) in enumerate(held)}
        self.waiting = [w for _, w in held]
        self.tokens = np.fromiter((k[0] for k, _ in held), np.int64, len(held))
        self.loss = np.fromiter((k[1] for k, _ in held), np.int64, len(held))
        self.count = np.fromiter((len(w) for _, w in held), np.int64, len(held))

    def best(self, tokens: int, segments: int, loss: int) -> int:
        """The waiting kind with the largest dot product that fits in what a sequence has left; -1 if none does."""
        fits = (self.count > 0) & (self.tokens <= tokens) & (self.loss <= loss)
        if segments < 1 or not fits.any():
            return -1
        most, _, most_loss = self.limits
        product = self.tokens * (tokens / most**2) + self.loss * (loss / max(most_loss, 1) ** 2)  # a segment adds the same to all
        return int(np.argmax(np.where(fits, product, -1.0)))

    def longest_cut(self, tokens: int, segments: int, loss: int) -> tuple[int, int]:
        """The waiting kind of which most can be cut off, and how much; of equal ones the longest."""
        if segments < 1 or tokens < 1 or not len(self.tokens):
            return -1, 0
        room = np.where(self.count > 0, np.minimum(np.minimum(tokens, loss + self.tokens - self.loss), self.tokens), 0)
        most = int(room.max())
        if most < 1:
            return -1, 0
        return int(np.argmax(np.where(room == most, self.tokens, -1))), most


def split(piece: tuple, at: int) -> tuple[tuple, tuple]:
    """A piece cut after ``at`` tokens; the loss-bearing ones are its last."""
    example, start, length, loss = piece
    first = max(0, at - (length - loss))
    return (example, start, at, first), (example, start + at, length - at, loss - first)


def fill(pool: Pool) -> list[tuple]:
    """The pieces of one more sequence."""
    tokens, segments, loss = pool.limits
    chosen: list[tuple] = []
    while tokens and segments:
        at = pool.best(tokens, segments, loss)
        if at >= 0:
            piece = pool.take(at)
        else:
            at, room = pool.longest_cut(tokens, segments, loss)
            if at < 0:
                break
            piece, rest = split(pool.take(at), room)
            pool.put(rest)
        chosen.append(piece)
        tokens, segments, loss = tokens - piece[2], segments - 1, loss - piece[3]
    used = pool.limits[0] - tokens
    over = used - (1 << used.bit_length() - 1) if tokens and used else 0
    while over:
        piece = chosen.pop()
        if piece[2] > over:
            kept, piece = split(piece, piece[2] - over)
            chosen.append(kept)
        over -= piece[2]
        pool.put(piece)
    return chosen


PIECES = "doc_id long, start long, length long, n_loss long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(examples: DataFrame, max_tokens: int = 1024, max_segments: int = 128, max_loss: int = 1024) -> DataFrame:
    """Rows of PIECES: where each id of examples (doc_id, ids, n_loss) went. ids: unsigned 32-bit little-endian integers."""
    if min(max_tokens, max_segments, max_loss) < 1:
        raise ValueError("a limit of less than one holds nothing")
    limits = (max_tokens, max_segments, max_loss)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, held, out = Pool(limits), {}, []
        sequence = (TaskContext.get().partitionId() << 33) - 1
        number, since = 0, 0

        def place(pieces: list[tuple]) -> None:
            nonlocal sequence
            sequence += 1
            offset = 0
            for example, start, length, loss in pieces:
                entry = held[example]
                doc, ids = entry[0], entry[1]
                out.append((doc, start, length, loss, ids[start : start + length].tobytes(), len(ids), sequence, offset))
                offset += length
                entry[2] -= length
                if not entry[2]:
                    del held[example]

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
            out.clear()
            return batch

        def drain(left: int) -> Iterator[pa.RecordBatch]:
            pool.tidy()
            rounds = 0
            while pool.total > left:
                place(fill(pool))
                rounds += 1
                if rounds % 64 == 0:
                    pool.tidy()
                if len(out) >= 4096:
                    yield made()

        for batch in batches:
            column = batch.column("ids")
            names, losses = batch.column("doc_id").to_pylist(), batch.column("n_loss").to_pylist()
            values = column.values.to_numpy(zero_copy_only=False).astype("<u4") if len(column.values) else np.zeros(0, "<u4")
            offsets, there = column.offsets.to_numpy(), column.is_valid().to_pylist()
            for i, name in enumerate(names):
                size = int(offsets[i + 1] - offsets[i]) if there[i] else 0
                if not size:
                    continue
                loss = size if losses[i] is None else min(max(losses[i], 0), size)
                held[number] = [name, values[offsets[i] : offsets[i + 1]].copy(), size]
                rest = (number, 0, size, loss)
                while rest[2]:
                    room = min(max_tokens, max_loss + rest[2] - rest[3], rest[2])
                    piece, rest = split(rest, room)
                    if piece[2] == max_tokens:
                        place([piece])
                        if len(out) >= 4096:
                            yield made()
                    else:
                        pool.put(piece)
                        since += piece[2]
                number += 1
                if since >= WINDOW:
                    since = 0
                    yield from drain(KEEP)
        yield from drain(0)
        if out:
            yield made()

    arrow = pa.schema([
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("n_loss", pa.int64()), ("ids", pa.binary()),
        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ])
    return examples.select(F.col("doc_id").cast("long").alias("doc_id"), "ids", F.col("n_loss").cast("long").alias("n_loss")).mapInArrow(work, PIECES)
