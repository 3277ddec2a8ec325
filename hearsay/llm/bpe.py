"""Byte-pair encoding and decoding of whole texts (operator 9).

Method: each pre-token is a doubly linked list of symbols; a priority queue of (merge rank, position) gives the
next merge, entries whose symbols have changed since are stale and skipped; decoding concatenates vocabulary
strings. Equal chunks of text are encoded once per worker (``kernels.IdCache``), so the queue runs over distinct
words only. No shuffle: each document is encoded where it is read.

Edge cases: a null or empty text, or one of white space only, has no ids and decodes to the empty string;
repeated rows and extra columns are kept as they are; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearsay.llm import kernels


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(plain))
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [table[b] for b in range(256)]


def vocabulary(path: str) -> list[str]:
    """The string of each id of a tokenizer file."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    entries = [*((i, text) for text, i in spec["model"]["vocab"].items()), *((t["id"], t["content"]) for t in spec["added_tokens"])]
    strings = [""] * (max(i for i, _ in entries) + 1)
    for i, text in entries:
        strings[i] = text
    return strings


class WordBpe:
    """A tokenizer file's vocabulary and merges, with the normalisation and pre-tokenisation that it asks for."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.strings = [""] * (max([*self.vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for text, i in self.vocab.items():
            self.strings[i] = text
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.added.items():
            self.strings[i] = text
        self.merges = {
            (self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(map(tuple, model["merges"]))
        }
        letters = byte_alphabet()
        self.first = [self.vocab.get(c) for c in letters]
        self.last = [self.vocab.get(c + self.suffix) for c in letters]
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.words: dict[str, list[int]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.first[b] for b in word[:-1]] + [self.last[word[-1]]]
        ids = [i for i in ids if i is not None]
        n, merges = len(ids), self.merges
        queue = []
        for i in range(n - 1):
            found = merges.get((ids[i], ids[i + 1]))
            if found:
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        if not queue:
            return ids
        heapq.heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # stale: one of the two symbols has been merged away
            ids[i], ids[j] = new, -1
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                found = merges.get((new, ids[k]))
                if found:
                    heapq.heappush(queue, (found[0], i, new, ids[k], found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get((ids[h], new))
                if found:
                    heapq.heappush(queue, (found[0], h, ids[h], new, found[1]))
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.specials.split(text) if "<|" in text else (text,):
            if piece in self.added:
                out.append(self.added[piece])
                continue
            if not piece.isascii():
                # lower() knows the final sigma, the tokenizer's lower case doesn't
                piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
            for word in self.cut.findall(piece.lower()):
                ids = self.words.get(word)
                if ids is None:
                    if len(self.words) >= 100_000:
                        self.words.clear()
                    ids = self.words[word] = self.merge(word.encode())
                out += ids
        return out

    def encode_chunks(self, chunks: list[bytes]) -> list[list[int]]:
        return [self.encode(c.decode("utf-8", "replace")) for c in chunks]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.strings[i] for i in ids])


def _encoder(path: str) -> kernels.IdCache:
    """One tokenizer and cache for each worker process."""
    return kernels.worker_state(("encode", path), lambda: kernels.IdCache(WordBpe(path).encode_chunks, most=1_000_000, most_bytes=32 << 20))


def _strings(path: str) -> list[str]:
    return kernels.worker_state(("decode", path), lambda: vocabulary(path))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each whole text in the array column ``ids``, without the text.

    path: the tokenizer's file; each worker reads it.
    """
    kept = [c for c in docs.columns if c not in (text, ids)]
    schema = docs.select(*kept).schema.add(ids, T.ArrayType(T.IntegerType()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _encoder(path)
        for batch in batches:
            texts = batch.column(text)
            for run in kernels.runs(texts):
                flat, bounds = cache.ids(run)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))
                rows = batch.slice(run.first, len(run))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), lists], names=[*kept, ids])

    return docs.select(*kept, F.col(text)).mapInArrow(work, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with the text that its ids stand for, their vocabulary strings joined as the file asks."""
    kept = [c for c in encoded.columns if c != text]
    schema = encoded.select(*kept).schema.add(text, T.StringType())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = _strings(path)
        for batch in batches:
            column = batch.column(ids)
            at, flat = column.offsets.to_numpy(), column.values.to_numpy()
            for first in range(0, len(column), 256):  # bounds what is held as Python objects
                last = min(first + 256, len(column))
                out = [
                    " ".join([strings[i] for i in flat[at[k] : at[k + 1]].tolist()])
                    for k in range(first, last)
                ]
                rows = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), pa.array(out, pa.string())], names=[*kept, text])

    return encoded.select(*kept).mapInArrow(work, schema)
