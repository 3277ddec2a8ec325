"""Approximate nearest neighbours by cosine (operator 7).

Method: a forest of random-projection trees. A query walks all trees through one shared priority queue (the next cell
is the one whose splits the query misses by least, as a root of summed squares) and so lists the cells it visits;
candidates of the cells are reranked exactly, in double precision, on the original vectors.

The planes are fitted on a bounded sample (``sample`` vectors of smallest hash) and broadcast, whose size is so
bounded too; every row is indexed. Equal vectors are one point with its ``k + 1`` smallest ids, which is all that a
result can show of them. Cells are cut into blocks of about ``block`` points by hash; a query's vector goes to the
blocks of its cells and only its best of each block comes back, so no list of candidates is ever written.

``share`` of all cells, but four a tree at least, is visited by a query. What recall that gives depends on the vectors: where all directions are
alike, as in the given tables, near vectors are hardly nearer than others and the share must be large (0.13 of the cells
of 8 trees, about 0.6 of the points, for a recall of 0.96).

Edge cases: vectors that are null, zero, of another length than most, or that hold null or non-finite components, and
rows without an id, take no part; rows of equal id and vector count once; ties go to the smaller id; with fewer than k
candidates all are returned; an empty table gives an empty one. Extra columns are left out.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.llm import shared


class Tree:
    """Random planes, each halving the sample below it; cells are numbered from left to right."""

    def __init__(self, vectors: np.ndarray, leaf: int, rng: np.random.Generator):
        self.cells = 0
        self.top = self._split(vectors, leaf, rng)

    def _split(self, vectors: np.ndarray, leaf: int, rng: np.random.Generator):
        if len(vectors) > leaf:
            plane = rng.normal(size=vectors.shape[1])
            plane /= np.linalg.norm(plane)
            at = vectors @ plane
            middle = float(np.median(at))
            low = at < middle
            if low.any():  # else most of the sample is one point
                return plane, middle, self._split(vectors[low], leaf, rng), self._split(vectors[~low], leaf, rng)
        self.cells += 1
        return self.cells - 1

    def cells_of(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros(len(vectors), np.int64)

        def walk(node, rows: np.ndarray) -> None:
            if isinstance(node, int):
                out[rows] = node
                return
            plane, middle, left, right = node
            low = np.einsum("ij,j->i", vectors[rows], plane) < middle  # row by row: equal vectors never part
            walk(left, rows[low])
            walk(right, rows[~low])

        walk(self.top, np.arange(len(vectors)))
        return out


class Forest:
    def __init__(self, vectors: np.ndarray, trees: int, leaf: int, seed: int):
        rng = np.random.default_rng(seed)
        self.trees = [Tree(vectors, leaf, rng) for _ in range(trees)]
        self.base = np.cumsum([0, *(t.cells for t in self.trees)])

    @property
    def cells(self) -> int:
        return int(self.base[-1])

    def cells_of(self, vectors: np.ndarray) -> np.ndarray:
        """One column for each tree."""
        return np.stack([b + t.cells_of(vectors) for b, t in zip(self.base, self.trees, strict=False)], axis=1)

    def visit(self, vector: np.ndarray, count: int) -> list[int]:
        """The first ``count`` cells by the shared queue."""
        queue = [(0.0, i, i, t.top) for i, t in enumerate(self.trees)]
        found: list[int] = []
        number = len(queue)
        while queue and len(found) < count:
            missed, _, tree, node = heapq.heappop(queue)
            while not isinstance(node, int):
                plane, middle, left, right = node
                x = float(plane @ vector) - middle
                near, far = (left, right) if x < 0 else (right, left)
                number += 1
                heapq.heappush(queue, (missed + x * x, number, tree, far))
                node = near
            found.append(int(self.base[tree]) + node)
        return found


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in column]) if len(column) else np.zeros((0, 1))


def _binary(rows: DataFrame) -> DataFrame:
    """id, vector -> vec (doubles as bytes), ids; equal vectors of a batch are one row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = batch.column("vector")
                flat, at = lists.values.to_numpy(zero_copy_only=False).astype("<f8"), lists.offsets.to_numpy()
                found: dict[bytes, list[int]] = {}
                for i, name in enumerate(batch.column("id").to_pylist()):
                    found.setdefault((flat[at[i] : at[i + 1]] + 0.0).tobytes(), []).append(name)
                yield pa.RecordBatch.from_pydict({"vec": pa.array(found.keys(), pa.binary()), "ids": pa.array(found.values(), pa.list_(pa.int64()))})

    return rows.mapInArrow(work, "vec binary, ids array<bigint>")


def nearest(
    rows: DataFrame, queries: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding", trees: int = 8, leaves: int = 32,
    share: float = 0.13, sample: int = 16384, block: int = 8192, seed: int = 11,
) -> DataFrame:
    """For rows that meet the condition ``queries``: query_id, rank (from 1), vec_id, score (cosine)."""
    good = rows.filter(F.col(id).isNotNull() & usable(F.col(vector))).select(
        F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), queries.alias("asks")
    )
    lengths = Counter({r["n"]: r["count"] for r in good.groupBy(F.size("vector").alias("n")).count().collect()})  # one row a length
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return rows.sparkSession.createDataFrame([], schema)
    dim = min(n for n, c in lengths.items() if c == max(lengths.values()))
    good = good.filter(F.size("vector") == dim)

    smallest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    in_batch = _binary(good.select("id", "vector")).withColumn("ids", F.slice(F.array_sort(F.array_distinct("ids")), 1, k + 1))
    points = shared.written(in_batch.groupBy("vec").agg(smallest.alias("ids")), "points")
    drawn = points.select("vec", F.xxhash64(F.lit(seed), "vec").alias("h")).orderBy("h", "vec").limit(sample).select("vec").toArrow()
    vectors = _matrix(drawn.column("vec").combine_chunks()) if drawn.num_rows else np.zeros((0, dim))
    vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    forest = Forest(vectors, trees, max(64, -(-len(vectors) // leaves)), seed)
    sent = rows.sparkSession.sparkContext.broadcast(forest)
    visits = max(4 * trees, round(share * forest.cells))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                x = _matrix(part.column("vec"))
                cells = sent.value.cells_of(x / np.sqrt((x * x).sum(axis=1, keepdims=True)))
                at = pa.array(np.repeat(np.arange(len(x)), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), part.column("vec").take(at), part.column("ids").take(at)], names=["cell", "vec", "ids"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            names = batch.column("id")
            for i in range(batch.num_rows):
                x = lists[i].values.to_numpy(zero_copy_only=False).astype("<f8")
                cells = sent.value.visit(x / np.sqrt((x * x).sum()), visits)
                yield pa.RecordBatch.from_pydict({
                    "cell": pa.array(cells, pa.int64()), "vec": pa.array([x.tobytes()] * len(cells), pa.binary()),
                    "ids": pa.array([[names[i].as_py()]] * len(cells), pa.list_(pa.int64())),
                })

    indexed = points.mapInArrow(index, "cell long, vec binary, ids array<bigint>")
    # one row for each cell of the bounded forest
    sizes = F.broadcast(shared.cut(indexed.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))))
    held = indexed.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("vec"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("kind"), "vec", "ids")
    asked = good.filter("asks").select("id", "vector").mapInArrow(ask, "cell long, vec binary, ids array<bigint>").join(sizes, "cell")
    asked = asked.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "vec", "ids")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, vecs, ids, x, norms = None, [], [], None, None
        for batch in batches:
            names = list(zip(batch.column("cell").to_pylist(), batch.column("block").to_pylist(), strict=True))
            kinds, lists = batch.column("kind").to_pylist(), batch.column("ids").to_pylist()
            column = batch.column("vec")
            i, out = 0, []
            while i < len(names):
                if names[i] != current:
                    current, vecs, ids, x = names[i], [], [], None
                if kinds[i] == 0:
                    vecs.append(np.frombuffer(column[i].as_buffer(), np.float64))
                    ids.append(lists[i])
                    i += 1
                    continue
                j = i
                while j < len(names) and names[j] == current and j - i < 256:
                    j += 1
                if vecs:
                    if x is None:
                        x = np.stack(vecs)
                        norms = np.sqrt((x * x).sum(axis=1))
                    out += _best(_matrix(column.slice(i, j - i)), [q[0] for q in lists[i:j]], x, norms, ids, k)
                i = j
            if out:
                q, v, s = zip(*out, strict=True)
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    dealt = held.unionByName(asked).repartition("cell", "block").sortWithinPartitions("cell", "block", "kind")
    best = dealt.mapInArrow(rerank, "query_id long, vec_id long, score double").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(queries: np.ndarray, names: list[int], x: np.ndarray, norms: np.ndarray, ids: list[list[int]], k: int) -> list[tuple[int, int, float]]:
    """The k best of a block for each query; the product only preselects, each score is then summed in one fixed order."""
    sizes = np.sqrt((queries * queries).sum(axis=1))
    rough = (queries @ x.T) / norms / sizes[:, None]
    out = []
    for row, name, query, size in zip(rough, names, queries, sizes, strict=True):
        m = min(k + 1, len(row))
        floor = np.partition(row, len(row) - m)[len(row) - m] - 1e-9
        at = np.flatnonzero(row >= floor)
        scores = (x[at] * query).sum(axis=1) / (norms[at] * size)
        found = sorted((-s, v) for s, i in zip(scores.tolist(), at.tolist(), strict=True) for v in ids[i] if v != name)
        out += [(name, v, -s) for s, v in found[:k]]
    return out
