import math
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearsay.llm import mixing, queries


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=8), st.integers(0, 60))
def test_sainte_lague_is_highest_quotients(votes, seats):
    want = [0] * len(votes)
    if any(votes):
        for _ in range(seats):
            best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))
            want[best] += 1
    assert mixing.sainte_lague(np.array(votes), seats).tolist() == want


def plain_targets(sizes, cap=3.0):
    """Shares again and again until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        target = {s: cap * sizes[s] if s in full else left * weight[s] / open_ for s in names}
        over = {s for s in names if s not in full and target[s] > cap * sizes[s]}
        if not over:
            return target
        full |= over


def check(rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
    target, taken = plain_targets(sizes), defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        assert r.source_size == sizes[r.source]
        assert math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-6)
        taken[r.source] += r.taken
    for s, n in taken.items():
        assert abs(n - target[s]) <= max(16, 0.02 * target[s]), s


@pytest.mark.parametrize("shard_docs", [2048, 3])
def test_mix_against_plain_sharing(spark, shard_docs):
    rows = [(i, None if i % 7 == 0 else f"s{i % 5}", (i * 37) % 90 if i % 5 else 900) for i in range(200)] + [(3, "s3", 10), (3, "s3", 10), (999, "tiny", 40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("blocks_of_mine", F.lit(1))
    out = mixing.mix(docs, shard_docs=shard_docs, block=1)
    got = out.collect()
    assert len(got) == len(rows)
    check(got)
    again = mixing.mix(docs.repartition(7), shard_docs=shard_docs, block=1).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_query_on_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in queries.read(spark, sf_dir, "documents").collect()}
    got = queries.op4_mix(spark, sf_dir).withColumnRenamed("doc_id", "id").collect()
    assert {r.id for r in got} == set(docs)

    class Row:
        def __init__(self, r):
            self.source, self.size, self.source_size, self.target, self.taken = docs[r.id].source, r.size, r.source_size, r.target, r.taken

    for r in got:
        assert r.size == len(re.findall(mixing.WORD, docs[r.id].text or ""))
    check([Row(r) for r in got])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, source string, size long")
    assert mixing.mix(none).collect() == []
    nothing = spark.createDataFrame([(1, "a", 0), (2, None, None)], "doc_id long, source string, size long")
    assert sorted((r.doc_id, r.taken) for r in mixing.mix(nothing).collect()) == [(1, 0), (2, 0)]


def test_capped_seats_go_to_the_others():
    assert mixing.sainte_lague(np.array([10, 10, 1]), 9, np.array([2, 9, 9])).tolist() == [2, 6, 1]
    assert mixing.sainte_lague(np.array([10, 0]), 9, np.array([4, 9])).tolist() == [4, 0]


def test_names_do_not_clash(spark):
    names = ["quota", "blocks", "cell_size", "n_docs", "of", "shard", "shards", "in", "weight", "_key", "_sum", "_i", "_rows"]
    docs = spark.createDataFrame([(i, f"s{i % 3}", 10 + i, "w " * (10 + i), *range(len(names)), 1.5) for i in range(30)], "doc_id long, source string, size long, text string, " + ", ".join(f"`{n}` long" for n in names) + ", target double")
    out = mixing.mix(docs)
    assert out.columns == [*(c for c in docs.columns if c != "target"), "source_size", "target", "taken"]
    assert {tuple(r[n] for n in names) for r in out.collect()} == {tuple(range(len(names)))} and out.count() == 30
    assert mixing.mixed(docs).columns == docs.columns


def test_small_sources_have_their_targets(spark):
    small = {"a": 3, "b": 5, "c": 20, None: 1}
    docs = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(small.items())] + [(10 + i, "large", 50) for i in range(40)], "doc_id long, source string, size long")
    for shard_docs in (2048, 3):
        rows = mixing.mix(docs, shard_docs=shard_docs).collect()
        got = {}
        for r in rows:
            assert 0 <= r.taken <= 3 * r.size
            got[r.source] = got.get(r.source, 0) + r.taken
        for s, want in plain_targets({**small, "large": 2000}).items():
            assert abs(got[s] - want) <= 1, (s, got[s], want)
