import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from hearsay.llm import kernels, queries, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """rows: (doc_id, text) -> (doc_id, n_words, n_removed, kept), by a table of all windows."""
    seen = defaultdict(int)
    split = [WORD.findall(t or "") for _, t in rows]
    for w in split:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])] += 1
    out = []
    for (doc_id, _), w in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def operator(spark, rows, window, partitions=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    got = substrings.remove_repeats(docs, window).select("doc_id", "n_words", "n_removed", "kept").collect()
    return sorted((tuple(r) for r in got), key=str)


def test_against_all_windows(spark):
    rng = random.Random(5)
    words = ["w%d" % i for i in range(40)]
    passages = [[rng.choice(words) for _ in range(n)] for n in (12, 20, 9, 60)]
    rows = []
    for i in range(120):
        parts = [[rng.choice(words) for _ in range(rng.randint(0, 25))] for _ in range(3)]
        for p in rng.sample(passages, rng.randint(0, 2)):
            a = rng.randint(0, 4)
            parts.insert(1, p[a : len(p) - rng.randint(0, 4)])
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w for p in parts for w in p)))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (3, rows[3][1]), (502, None), (503, ""), (504, "  \n"), (None, rows[4][1])]
    rows += [(505, "a " * 300), (506, "b c " * 40), (507, "é 日本 x" * 3), (508, " ".join(words) + "\n"), (509, "\t" + " ".join(words))]
    for window in (10, 7):
        assert operator(spark, rows, window) == brute(rows, window)


def test_production_window_on_few_words(spark):
    rng = random.Random(9)
    base = [str(rng.randint(0, 2)) for _ in range(400)]
    rows = [(0, " ".join(base)), (1, " ".join(base[:200] + ["x"] + base[200:])), (2, " ".join(base[100:135])), (3, " ".join(base[100:134]))]
    rows += [(4, " ".join(base[50:90] + base[50:90]))]
    assert operator(spark, rows, 35) == brute(rows, 35)


def test_query_on_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in queries.read(spark, sf_dir, "documents").collect()]
    want = [(d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in brute(rows, 35)]
    got = queries.op6_substrings(spark, sf_dir).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert sum(g for _, _, g, _ in want) > 0


def test_empty_table(spark):
    assert operator(spark, [], 35) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té", max_size=12) | st.none(), min_size=1, max_size=6))
def test_words_and_kept_text(texts):
    arr = pa.array(texts, pa.string())
    found, kept = [], []
    for run in kernels.runs(arr, most=7):
        starts, ends, bounds, buf = kernels.words(run)
        raw = run.buf.tobytes()
        for i in range(len(run)):
            found.append([raw[starts[j] : ends[j]].decode() for j in range(bounds[i], bounds[i + 1])])
        keep = np.arange(len(starts)) % 2 == 0
        kept += kernels.kept_text(run, starts, ends, bounds, keep).to_pylist()
        flags = iter(keep.tolist())
        for i in range(len(run)):
            words = found[run.first + i]
            assert kept[run.first + i] == " ".join(w for w in words if next(flags))
    assert found == [WORD.findall(t or "") for t in texts]


def test_equal_rows_and_clashing_names(spark):
    text = " ".join("e%d" % i for i in range(300))
    docs = spark.createDataFrame([(1, text, 5, 6, "k") for _ in range(400)] + [(2, "other words", 7, 8, "k")], "doc_id long, text string, ranges long, _key long, kept string")
    got = substrings.remove_repeats(docs, 35)
    assert got.columns == ["doc_id", "text", "ranges", "_key", "n_words", "n_removed", "kept"]
    rows = got.collect()
    assert len(rows) == 401 and {(r.ranges, r._key, r.n_removed) for r in rows} == {(5, 6, 300), (7, 8, 0)}
    assert substrings.covered(docs.selectExpr("xxhash64(doc_id, text) AS _hearsay_key", "text")).selectExpr("max(size(ranges))").first()[0] < 400
