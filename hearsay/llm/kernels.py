"""Vectorised text kernels that run inside Spark tasks on Arrow batches.

A batch of texts is one UTF-8 byte buffer with document offsets. Words and chunks are spans of that
buffer; their 64-bit hashes come from one prefix sum over the buffer, so no Python object is made for a word.
All functions take whole texts; a batch is cut into runs of documents of about ``RUN_BYTES`` so that memory
stays bounded however many rows an Arrow batch has (one longer text is a run of its own).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once.
RUN_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_TABLES: dict[str, np.ndarray] = {}


_STATE: dict = {}


def worker_state(key, make):
    """What make() gives, kept by this worker process for the next tasks; only the last key's, so that a worker that serves
    several operators in turn holds the tables of one."""
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = make()
    return _STATE[key]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-dependent hash of two hashes."""
    return mix(a * _U(0xD6E8FEB86659FD93) + (b ^ (b >> _U(32))) * _U(0xA0761D6478BD642F) + _U(0x2545F4914F6CDD1D))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i up to n, and a random value for each byte."""
    if len(_TABLES.get("up", ())) < n + 1:
        size = max(n + 1, RUN_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            out = np.full(size, base, _U)
            out[0] = 1
            _TABLES[name] = np.multiply.accumulate(out)
        _TABLES["byte"] = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
    return _TABLES["up"], _TABLES["down"], _TABLES["byte"]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes and length."""
    up, down, table = _powers(len(buf))
    sums = np.zeros(len(buf) + 1, _U)
    np.cumsum(table[buf] * up[: len(buf)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * down[starts]
    return mix(raw + (ends - starts).astype(_U) * _U(0x9FB21C651E98DF25))


class Run:
    """Some consecutive texts of a batch: rows ``first`` to ``last``, their bytes and offsets within them."""

    __slots__ = ("buf", "first", "last", "offsets")

    def __init__(self, first: int, last: int, buf: np.ndarray, offsets: np.ndarray):
        self.first, self.last, self.buf, self.offsets = first, last, buf, offsets

    def __len__(self) -> int:
        return self.last - self.first


def runs(texts: pa.Array, most: int = RUN_BYTES) -> Iterator[Run]:
    """The texts of a column as runs; a null text is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield Run(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def words(run: Run, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document bounds of the words ``[^\\x20\\x09-\\x0D]+``, and the bytes they are in.

    The words of document i are those from bounds[i] to bounds[i + 1].
    """
    buf = _LOWER[run.buf] if lower else run.buf
    inside = ~_SPACE[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = run.offsets[1:-1]
    edges = edges[edges < len(buf)]
    begins[edges] = inside[edges]  # a text's first byte begins a word whatever the text before ends with
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | begins[1:]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, run.offsets), buf


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` consecutive items, by doubling; item i starts window i."""
    if len(hashes) < length:
        return hashes[:0]
    level, out = 1, hashes
    while level * 2 <= length:
        out = combine(out[:-level], out[level:])
        level *= 2
    if level < length:
        out = combine(out[: len(out) - (length - level)], out[length - level :])
    return out[: len(hashes) - length + 1]


def window_docs(bounds: np.ndarray, length: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window position: does it lie within one document; and the document of each position."""
    docs = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    docs = docs[:count] if len(docs) >= count else docs
    ends = bounds[1:][docs]
    return np.arange(count) + length <= ends, docs


def chunks(run: Run) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document bounds of chunks that no pre-token of a GPT-like tokenizer crosses.

    Cuts: before a space between two other bytes that are not ASCII white space; before and after a line feed
    between two ASCII bytes that are not white space; before . , ; : ! ? that follow an ASCII letter. Each is an
    edge of pre-tokens, and none changes how the text on its two sides is cut.
    """
    buf = run.buf
    n = len(buf)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        space = _SPACE[buf]
        solid = ~space
        between = solid[:-2] & solid[2:]
        cut[1 : n - 1] |= (buf[1:-1] == 0x20) & between
        ascii_ = solid & (buf < 0x80)
        feed = (buf[1:-1] == 0x0A) & ascii_[:-2] & ascii_[2:]
        cut[1 : n - 1] |= feed
        cut[2:n] |= feed
        low = buf | 0x20
        letter = (low >= 0x61) & (low <= 0x7A)
        stop = np.isin(buf, np.frombuffer(b".,;:!?", np.uint8))
        cut[1:n] |= letter[:-1] & stop[1:]
    cut[run.offsets] = True
    cut[n] = False
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], n) if len(starts) else starts
    return starts, ends, np.searchsorted(starts, run.offsets)


class IdCache:
    """Token ids of distinct chunks by hash, kept by a worker from batch to batch.

    Hashes are in a table with open addressing. Both the number of chunks and the bytes of their ids are bounded; when
    either is reached, the cache is emptied.
    """

    def __init__(self, make, most: int = 1_500_000, most_bytes: int = 96 << 20):
        """make: list of byte strings -> list of id lists."""
        self.make, self.most, self.most_bytes = make, most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.keys, self.places = np.zeros(1 << 16, _U), np.zeros(1 << 16, np.int32)
        self.flat, self.offsets, self.used, self.count = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0, 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of hashes; -1 where one is not in the table."""
        mask = _U(len(self.keys) - 1)
        slots = hashes & mask
        held = self.keys[slots]
        places = np.where(held == hashes, self.places[slots], -1)
        open_ = np.flatnonzero((held != hashes) & (held != 0))
        while len(open_):
            slots[open_] = (slots[open_] + _U(1)) & mask
            at = slots[open_]
            held, mine = self.keys[at], hashes[open_]
            hit = held == mine
            places[open_[hit]] = self.places[at[hit]]
            open_ = open_[~hit & (held != 0)]
        return places

    def _put(self, hashes: np.ndarray, places: np.ndarray) -> None:
        """Distinct hashes that are not in the table; where several meet at a free slot, the others go on."""
        mask = _U(len(self.keys) - 1)
        slots = hashes & mask
        while len(hashes):
            free = self.keys[slots] == 0
            self.keys[slots[free]] = hashes[free]
            mine = free & (self.keys[slots] == hashes)
            self.places[slots[mine]] = places[mine]
            hashes, places, slots = hashes[~mine], places[~mine], (slots[~mine] + _U(1)) & mask

    def _add(self, hashes: np.ndarray, lists: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        total = int(lengths.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + len(lists) + 1 > len(self.offsets):
            self.offsets = np.concatenate([self.offsets, np.zeros_like(self.offsets)])
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(lists), np.int32, total)
        self.offsets[self.count + 1 : self.count + 1 + len(lists)] = self.used + np.cumsum(lengths)
        if 2 * (self.count + len(lists)) > len(self.keys):
            at = np.flatnonzero(self.keys)
            held, where = self.keys[at], self.places[at]
            size = 1 << int(4 * (self.count + len(lists)) - 1).bit_length()
            self.keys, self.places = np.zeros(size, _U), np.zeros(size, np.int32)
            self._put(held, where)
        self._put(hashes, (self.count + np.arange(len(lists))).astype(np.int32))
        self.used += total
        self.count += len(lists)

    def _places(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        hashes = np.maximum(span_hashes(buf, starts, ends), _U(1))
        places = self._find(hashes)
        missing = np.flatnonzero(places < 0)
        if len(missing):
            if self.count + len(missing) > self.most or 4 * self.used > self.most_bytes:
                self.clear()
                missing = np.arange(len(hashes))
            order = missing[np.argsort(hashes[missing], kind="stable")]
            keys = hashes[order]
            edge = np.append(True, keys[1:] != keys[:-1])
            raw, keys, first = buf.tobytes(), keys[edge], order[edge]
            self._add(keys, self.make([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]))
            places[missing] = self._find(hashes[missing])
        return places

    def ids(self, run: Run, spans=None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a run's texts, and the bounds of each text's ids; of its chunks, or of given spans."""
        starts, ends, bounds = spans or chunks(run)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(run) + 1, np.int64)
        places = self._places(run.buf, starts, ends)
        lows = self.offsets[places]
        lengths = self.offsets[places + 1] - lows
        sums = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=sums[1:])
        at = np.repeat(lows - sums[:-1], lengths) + np.arange(sums[-1])
        return self.flat[at], sums[bounds]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the values from each start to its end (excluded), and of how many they are."""
    up, down, _ = _powers(len(values))
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0x9FB21C651E98DF25))


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of each ``width`` consecutive values, the leftmost of equals, by doubling."""
    place, level = np.arange(len(values)), 1
    best = values

    def join(step: int) -> None:
        nonlocal best, place
        left = best[:-step] <= best[step:]
        place = np.where(left, place[:-step], place[step:])
        best = np.where(left, best[:-step], best[step:])

    while level * 2 <= width:
        join(level)
        level *= 2
    if level < width:
        join(width - level)
    return place


def kept_text(run: Run, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, keep: np.ndarray) -> pa.Array:
    """Each text's kept words joined by one space."""
    mask = np.zeros(len(run.buf) + 1, np.int32)
    kept = np.flatnonzero(keep)
    np.add.at(mask, starts[kept], 1)
    np.add.at(mask, ends[kept], -1)
    mask = np.cumsum(mask[:-1]).astype(bool)
    docs = np.searchsorted(bounds, kept, "right")
    followed = kept[:-1][docs[:-1] == docs[1:]] if len(kept) else kept
    buf = run.buf.copy()
    buf[ends[followed]] = 0x20
    mask[ends[followed]] = True
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    offsets = sums[run.offsets].astype(np.int32)
    return pa.StringArray.from_buffers(len(run), pa.py_buffer(offsets), pa.py_buffer(buf[mask]))
