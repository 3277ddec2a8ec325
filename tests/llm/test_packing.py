import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hearsay.llm import packing, queries

BPE = f"{queries.TOKENIZERS}/byte_bpe_50k.json"


def check(pieces, limits=(1024, 128, 1024)):
    """Sequences hold their limits, are gapless, and need no padding; how many there are."""
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        at = 0
        for p in own:
            assert p.offset == at and p.length > 0 and len(p.ids) == 4 * p.length
            at += p.length
        assert len(own) <= limits[1] and sum(p.n_loss for p in own) <= limits[2]
        assert at <= limits[0] and (at == limits[0] or at & at - 1 == 0)
    return sequences


def whole(pieces):
    """Each example's ids, put together from its pieces."""
    docs = defaultdict(list)
    for p in sorted(pieces, key=lambda p: (p.doc_id is None, p.doc_id or 0, p.start)):
        docs[p.doc_id].append(p)
    out = {}
    for name, own in docs.items():
        assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]] and {p.doc_tokens for p in own} == {sum(p.length for p in own)}
        out[name] = np.frombuffer(b"".join(p.ids for p in own), "<u4").tolist()
    return out


def test_query_on_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = queries.op12_packing(spark, sf_dir).collect()
    tokenizer = Tokenizer.from_file(BPE)
    used, filled = defaultdict(int), defaultdict(int)
    texts = {r.doc_id: r.text or "" for r in queries.read(spark, sf_dir, "documents").collect()}
    ids = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for d, t in texts.items()}
    for r in rows:
        own = np.array(ids[r.doc_id], "<u4")
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        used[r.doc_id] += r.length
        filled[r.sequence_id] += r.length
    assert used == {d: len(v) for d, v in ids.items()}
    assert all(n == 1024 or n & n - 1 == 0 for n in filled.values())
    assert sum(n == 1024 for n in filled.values()) > 0.8 * len(filled)


def examples(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, ids array<int>, n_loss long, offset string")


@pytest.mark.parametrize("limits", [(64, 5, 20), (64, 3, 64), (50, 100, 7), (16, 1, 1)])
def test_three_limits_hold_and_every_id_is_in_one_piece(spark, limits):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        n = int(rng.integers(1, 200))
        rows.append((i, list(range(i * 1000, i * 1000 + n)), int(rng.integers(0, n + 1)), "clash"))
    pieces = packing.pack(examples(spark, rows), *limits).collect()
    check(pieces, limits)
    assert whole(pieces) == {i: ids for i, ids, _, _ in rows}
    by_start = {(p.doc_id, p.start): p for p in pieces}
    for (doc, start), p in by_start.items():  # loss-bearing tokens are the last of an example
        n, loss = len(rows[doc][1]), rows[doc][2]
        assert p.n_loss == max(0, min(start + p.length, n) - max(start, n - loss))


def test_odd_rows(spark):
    rows = [(1, [], 0, ""), (2, None, None, ""), (None, [7, 8], None, ""), (3, [5] * 5000, 9000, ""), (4, [6], -3, "")]
    pieces = packing.pack(examples(spark, rows)).collect()
    check(pieces)
    assert whole(pieces) == {None: [7, 8], 3: [5] * 5000, 4: [6]}
    assert {p.doc_id: p.n_loss for p in pieces if p.doc_id != 3} == {None: 2, 4: 0}
    twice = packing.pack(examples(spark, [(1, [1, 2, 3], 3, "")] * 50)).collect()
    check(twice)
    assert sum(p.length for p in twice) == 150
    assert packing.pack(examples(spark, [])).collect() == []
    with pytest.raises(ValueError):
        packing.pack(examples(spark, rows), 0)


def test_odd_texts(spark):
    table = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "ab " * 200_000, "x"), (None, "é\U0001f600", "x")], "doc_id long, text string, ids string")
    pieces = packing.pack(packing.token_ids(table, BPE, 0)).collect()
    check(pieces)
    tokenizer = Tokenizer.from_file(BPE)
    texts = {1: "", 2: "", 3: "ab " * 200_000, None: "é\U0001f600"}
    assert whole(pieces) == {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for d, t in texts.items()}


def test_windows_bound_what_is_held(spark, monkeypatch):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.sequence(F.lit(1), (F.col("id") % 700 + 1).cast("int")).alias("ids"), (F.col("id") % 300).alias("n_loss"), F.lit("").alias("offset"))
    monkeypatch.setattr(packing, "WINDOW", 20_000)
    monkeypatch.setattr(packing, "KEEP", 5_000)
    pieces = packing.pack(rows.coalesce(1)).collect()
    sequences = check(pieces)
    assert whole(pieces) == {i: list(range(1, i % 700 + 2)) for i in range(3000)}
    assert sum(sum(p.length for p in s) == 1024 for s in sequences.values()) > 0.98 * len(sequences)


def test_dot_product_prefers_what_a_sequence_has_left():
    pool = packing.Pool((100, 10, 100))
    for piece in ((0, 0, 60, 10), (1, 0, 50, 50), (2, 0, 30, 30)):
        pool.put(piece)
    pool.tidy()
    assert pool.waiting[pool.best(100, 10, 100)][0][0] == 1  # balanced residual: 50 + 50 beats 60 + 10
    assert pool.waiting[pool.best(90, 10, 12)][0][0] == 0  # only one fits in what is left of the loss
    assert pool.best(20, 10, 20) == -1 and pool.best(100, 0, 100) == -1
