import math

import numpy as np
from pyspark.sql import functions as F

from hearsay.llm import ann, queries


def brute(rows, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    ids = np.array([i for i, _ in good])
    x = np.stack([v for _, v in good])
    norms = np.sqrt((x * x).sum(axis=1))
    out = {}
    for i, v in good:
        if i % 50 == 0:
            scores = (x * v).sum(axis=1) / (norms * math.sqrt((v * v).sum()))
            out[i] = sorted((-s, j) for s, j in zip(scores.tolist(), ids.tolist(), strict=True) if j != i)[:k]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    hits = sum(len({j for _, j in got.get(q, [])} & {j for _, j in w}) for q, w in want.items())
    return hits / sum(len(w) for w in want.values())


def test_odd_rows_and_ties_are_exact_on_a_small_table(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(30)] + [(200, [2.0, 4.0, 6.0, 8.0]), (7, rows[7][1])]
    rows += [(300, None), (301, [0.0] * 4), (302, [1.0, None, 0.0, 0.0]), (350, [float("nan")] * 4), (None, [1.0] * 4), (400, [float("inf"), 0.0, 0.0, 0.0]), (401, [1.0])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(5)
    kept = [(i, v) for i, v in dict(((i, str(v)), (i, v)) for i, v in rows).values() if i != 401]
    got, want = result(ann.nearest(table, F.col("vec_id") % 50 == 0)), brute(kept)
    assert got.keys() == want.keys()
    for q, w in want.items():
        assert [j for _, j in got[q]] == [j for _, j in w]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in w], atol=1e-15)


def test_fewer_rows_than_asked_for(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [j for _, j in result(ann.nearest(table, F.col("vec_id") % 50 == 0))[0]] == [1]
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert ann.nearest(none, F.col("vec_id") % 50 == 0).collect() == []


def test_recall_with_small_cells_and_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 24))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = brute([(i, v.tolist()) for i, v in enumerate(x)])
    got = result(ann.nearest(table, F.col("vec_id") % 50 == 0, block=40, sample=2000))
    assert recall(got, want) >= 0.9


def test_query_recall_on_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r.vec_id, list(r.embedding)) for r in queries.read(spark, sf_dir, "embeddings").collect()]
    got, want = result(queries.op7_neighbours(spark, sf_dir)), brute(rows)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert recall(got, want) >= 0.9
