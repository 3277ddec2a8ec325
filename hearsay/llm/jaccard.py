"""Join of documents by the Jaccard similarity of their word n-grams (operator 2).

Texts are lower-cased (A-Z) and cut into words; a document's set is its distinct ``size``-word shingles, or the whole
sequence where there are fewer words. Two documents link when intersection >= threshold * union, exactly.

Method: a count-vector R-tree. Shingles are hashed into groups, a set is the point of its group counts, and the sum of
coordinate minima bounds the overlap of two sets, or of a set and all points under a tree node (by the node's coordinate
maxima and its least and largest set). Pairs that pass the bound are verified on the sets themselves.

A tree of all sets would be searched in vain nearly everywhere, so sets first meet where they can be linked at all:

1. documents of equal sets are one class; whatever follows is about classes;
2. a class shows the prefix of its set (in one order for all: frequent shingles last) of which every linked class must
   have a number in proportion to its size; shingles that no other class of a size that can be linked shows are dropped, then
   classes with too few left;
3. each class is compared with the centres of its shingles, that is the class of each that meets most others: with the two
   that are centres most often. That gives two links to a class at most, and joins nearly all near copies;
4. where the classes of a shingle are in several components still, those of shingles with the same largest component are
   put under trees, in blocks of about ``chunk``, which are searched for all classes outside that component: these meet
   all classes there, so that no pair of two components is left out. Of two components the ``tries`` pairs with the widest bound are verified; where there
   were more, and the components are still two, the search is done again for such components, with many more tries, until no
   pair is left.

Frequent is what runs of about a million shingles have in two or more of their classes, at least 1 / ``frequent`` of all such counts, so there are
no more than ``frequent`` such shingles, which are broadcast with 12 bytes each. The order only moves work, never the
result. Frequent shingles are dealt out in pieces, so no task gets all classes of one.

Rows, sets and shingles are told apart by 64-bit hashes.

Edge cases: null texts and texts without words have an empty set and link with nothing; equal rows are documents of one
class; ties (equal least ids) do not matter, as a component is named by its smallest doc_id; null ids are larger than
any other; texts are read whole, one task holding one batch of them and one set; an empty table gives an empty one;
extra columns are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.llm import components, kernels, shared

_KEY = "_hearsay_row_key"


def shingle_sets(run: kernels.Run, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts of a run, and each text's bounds."""
    starts, ends, bounds, buf = kernels.words(run, lower=True)
    words = kernels.span_hashes(buf, starts, ends)
    grams = kernels.windows(words, size)
    docs = np.repeat(np.arange(len(run)), np.diff(bounds))
    inside = docs[: len(grams)]
    good = np.arange(len(grams)) + size <= bounds[1:][inside]
    counts = np.diff(bounds)
    short = np.flatnonzero((counts > 0) & (counts < size))
    whole = kernels.range_hashes(words, bounds[short], bounds[short + 1]) if len(short) else grams[:0]
    hashes, docs = np.concatenate([grams[good], whole]), np.concatenate([inside[good], short])
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    hashes, docs = hashes[first], docs[first]
    return hashes, np.searchsorted(docs, np.arange(len(run) + 1))


def set_ids(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(kernels.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
    return kernels.mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64))


def points(hashes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The group of each shingle of a set, sorted: its group counts in short."""
    docs = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    groups = ((hashes >> np.uint64(20)) & np.uint64(0xFFFF)).astype("<u2")
    groups = groups[np.lexsort((groups, docs))]
    return [groups[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _occurrences(point: np.ndarray) -> np.ndarray:
    """Group and number of each occurrence of it: what two sets have in common is the sum of coordinate minima."""
    edge = np.flatnonzero(np.append(True, point[1:] != point[:-1])) if len(point) else np.zeros(0, np.int64)
    number = np.arange(len(point)) - np.repeat(edge, np.diff(np.append(edge, len(point))))
    return (point.astype(np.int64) << 32) | number


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sorted arrays without repeats have in common."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    return int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum()) if len(small) else 0


class Tree:
    """An R-tree over points: each node has the coordinate maxima of what is under it, and its least and largest size.

    The tree has few groups; a point that it lets pass is bounded once more by all of them.
    """

    def __init__(self, found: list[np.ndarray], threshold: Fraction, fan: int = 16):
        self.num, self.den, self.fan = threshold.numerator, threshold.denominator, fan
        sizes = np.array([len(p) for p in found], np.int64)
        self.groups = 1 << int(np.clip(np.floor(np.log2(max(1.0, float(np.median(sizes))))) - 1, 5, 12))
        self.fine = [_occurrences(p) for p in found]
        counts = np.stack([self.coarse(p) for p in found]).astype(np.int32)
        widest = np.argsort(-counts.var(axis=0))[:24]
        bits = counts[:, widest] > np.median(counts[:, widest], axis=0)  # like points are alike in these
        self.order = np.lexsort((sizes, *bits.T[::-1]))
        most, low, high = counts[self.order], sizes[self.order], sizes[self.order]
        self.levels = [(most, low, high)]
        while len(most) > fan:
            at = np.arange(0, len(most), fan)
            most, low, high = np.maximum.reduceat(most, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((most, low, high))

    def coarse(self, point: np.ndarray) -> np.ndarray:
        return np.bincount(point & np.uint16(self.groups - 1), minlength=self.groups)

    def search(self, point: np.ndarray) -> np.ndarray:
        """Points that the tree lets pass."""
        mine, n = self.coarse(point), len(point)
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            most, low, high = self.levels[depth]
            nodes = nodes[(low[nodes] * self.num <= n * self.den) & (high[nodes] * self.den >= n * self.num)]
            overlap = np.minimum(most[nodes], mine).sum(axis=1)
            nodes = nodes[overlap * (self.num + self.den) >= self.num * (n + low[nodes])]
            if depth:
                nodes = (nodes[:, None] * self.fan + np.arange(self.fan)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][0])]
        return self.order[nodes]

    def spare(self, fine: np.ndarray, j: int) -> int:
        """By how much the bound of a set (its occurrences) and point j is more than a link needs."""
        return _common(fine, self.fine[j]) * (self.num + self.den) - self.num * (len(fine) + len(self.fine[j]))


def _overlaps(a: np.ndarray, b: np.ndarray, threshold: Fraction) -> bool:
    """Are two sorted sets linked."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    num, den = threshold.numerator, threshold.denominator
    if not len(small) or len(small) * den < len(large) * num:
        return False
    return _common(small, large) * (num + den) >= num * (len(a) + len(b))


def _sizes(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, row key, n, set_id and, in some rows, shingles that several classes of a batch have, with their numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            seen: list[np.ndarray] = []
            known: set[int] = set()

            def flush() -> pa.RecordBatch:
                """What was read since the last time; the first row has the repeated shingles."""
                often, counts = np.unique(np.concatenate(seen), return_counts=True)
                often, counts = often[counts > 1], counts[counts > 1]
                first, last = rows[0][0].first, rows[-1][0].last  # noqa: B023
                ends = np.full(last - first + 1, len(often), np.int32)
                ends[0] = 0
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (often.view(np.int64), counts)]
                made = pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, last - first) for c in ("doc_id", _KEY)),  # noqa: B023
                     pa.array(np.concatenate([r[1] for r in rows]).astype(np.int64)), pa.array(np.concatenate([r[2] for r in rows]).view(np.int64)), *lists],  # noqa: B023
                    names=["doc_id", _KEY, "n", "set_id", "often", "counts"],
                )
                rows.clear()  # noqa: B023
                seen.clear()  # noqa: B023
                known.clear()  # noqa: B023
                return made

            for run in kernels.runs(batch.column("text")):
                hashes, bounds = shingle_sets(run, size)
                ids = set_ids(hashes, bounds)
                new = np.zeros(len(run), bool)
                for i, s in enumerate(ids.tolist()):
                    if s not in known:
                        known.add(s)
                        new[i] = True
                seen.append(hashes[np.repeat(new, np.diff(bounds))])
                rows.append((run, np.diff(bounds), ids))
                if sum(map(len, seen)) > 1 << 20:
                    yield flush()
            if rows:
                yield flush()

    return docs.mapInArrow(work, f"doc_id long, {_KEY} long, n long, set_id long, often array<bigint>, counts array<bigint>")


def _shown(docs: DataFrame, size: int, threshold: Fraction, late: np.ndarray, pieces: np.ndarray) -> DataFrame:
    """token, piece, set_id, n: the shingles that a class shows. Those in ``late`` (sorted) come last and have a piece from 1
    on, by the class; others have piece 0. Copies of a class in one task are seldom shown twice."""
    num, den = threshold.numerator, threshold.denominator
    sent = docs.sparkSession.sparkContext.broadcast((late, pieces))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, parts = sent.value
        known: set[int] = set()
        for batch in batches:
            for run in kernels.runs(batch.column("text")):
                hashes, bounds = shingle_sets(run, size)
                n, ids = np.diff(bounds), set_ids(hashes, bounds)
                if len(known) > 1 << 18:
                    known.clear()
                new = np.zeros(len(run), bool)
                for i, s in enumerate(ids.tolist()):
                    new[i] = s not in known
                    known.add(s)
                docs_ = np.repeat(np.arange(len(run)), n)
                piece = np.zeros(len(hashes), np.int32)
                order, last = _late_last(hashes, docs_, often)
                piece[last] = 1 + (kernels.mix(ids[docs_[last]] ^ hashes[last]) % parts[np.searchsorted(often, hashes[last])].astype(np.uint64)).astype(np.int32)
                hashes, piece = hashes[order], piece[order]
                take = (np.arange(len(hashes)) - bounds[docs_] < shows(n, num, den)[docs_]) & new[docs_]
                yield pa.RecordBatch.from_pydict({
                    "token": hashes[take].view(np.int64), "piece": piece[take], "set_id": ids[docs_[take]].view(np.int64), "n": n[docs_[take]].astype(np.int32),
                })

    return docs.select("text").mapInArrow(work, "token long, piece int, set_id long, n int")


def shows(n, num: int, den: int):
    """How many shingles a set of n shows: as many as it can lack, and as many as linked sets must then have in common."""
    return n - (num * n + den - 1) // den + np.maximum(1, n // 16)


def _enough(threshold: Fraction, n: Column) -> Column:
    """Shown shingles that a set of n has in common with any it is linked with, the smallest of which has threshold * n."""
    return F.greatest(F.lit(1), F.floor(n * threshold.numerator / (16 * threshold.denominator)))


def _late_last(hashes: np.ndarray, docs: np.ndarray, late: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order in which sets show their shingles, and which of them are late ones."""
    if not len(late) or not len(hashes):
        return np.arange(len(hashes)), np.zeros(len(hashes), bool)
    last = late[np.minimum(np.searchsorted(late, hashes), len(late) - 1)] == hashes
    return np.lexsort((hashes, last, docs)), last


def _fits(threshold: Fraction, a: str = "na", b: str = "nb") -> Column:
    return F.greatest(a, b) * threshold.numerator <= F.least(a, b) * threshold.denominator


def _held(keyed: DataFrame, sizes: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """set_id, n, point, text of one document of each class in ids (set_id)."""
    one = shared.cut(sizes.filter("n > 0").groupBy("set_id").agg(F.min(_KEY).alias(_KEY)).join(ids, "set_id", "left_semi"))
    # most texts are of no such class: they are left out before texts are dealt
    rows = shared.likely(keyed.select(_KEY, "text"), _KEY, one.select(_KEY)).join(one, _KEY).dropDuplicates([_KEY, "set_id"]).select("set_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in kernels.runs(batch.column("text")):
                hashes, bounds = shingle_sets(run, size)
                here = batch.slice(run.first, len(run))
                made = [p.tobytes() for p in points(hashes, bounds)]
                yield pa.RecordBatch.from_arrays(
                    [here.column("set_id"), pa.array(np.diff(bounds).astype(np.int32)), pa.array(made, pa.binary()), here.column("text")],
                    names=["set_id", "n", "point", "text"],
                )

    return rows.mapInArrow(work, "set_id long, n int, point binary, text string")


def _verified(pairs: DataFrame, held: DataFrame, size: int, threshold: Fraction, rows_at_once: int = 2048) -> DataFrame:
    """Pairs (a, b) whose sets are linked. A set b that many are compared with goes to several tasks."""
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / rows_at_once).cast("int").alias("parts"))
    texts = shared.likely(held.select("set_id", "text"), "set_id", pairs.select(F.explode(F.array("a", "b"))))
    heads = parts.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("b").alias("a"), F.lit(0).alias("kind"))
    rows = pairs.join(parts, "b").select("b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), "a", F.lit(1).alias("kind"))
    rows = rows.unionByName(heads).join(texts, F.col("a") == F.col("set_id")).select("b", "part", "kind", "a", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(0, np.uint64)
        for batch in batches:
            b, a, kind = (batch.column(c).to_pylist() for c in ("b", "a", "kind"))
            out: list[tuple[int, int]] = []
            for run in kernels.runs(batch.column("text")):
                hashes, bounds = shingle_sets(run, size)
                for k, i in enumerate(range(run.first, run.last)):
                    s = hashes[bounds[k] : bounds[k + 1]]
                    if kind[i] == 0:
                        mine = s.copy()
                    elif _overlaps(mine, s, threshold):
                        out.append((a[i], b[i]))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return rows.repartition("b", "part").sortWithinPartitions("b", "part", "kind").mapInArrow(work, "a long, b long")


def _searched(rows: DataFrame, held: DataFrame, threshold: Fraction, tries: int) -> DataFrame:
    """rows (top, band, block, kind, comp, set_id) -> pairs a, b of two components that the bound lets pass, and whether
    their components had more. kind: 0 in the tree, of the largest component there; 1 in the tree; 2 searched for."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, index, tree = None, [], None
        best: dict[tuple[int, int], list] = {}
        more: set[tuple[int, int]] = set()

        def close() -> pa.RecordBatch:
            pairs = [(x, y, k in more) for k, found in best.items() for _, x, y in found]
            best.clear()
            more.clear()
            a, b, m = zip(*pairs, strict=True) if pairs else ([], [], [])
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "more": pa.array(m, pa.bool_())})

        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in ("top", "band", "block")), strict=True))
            kinds, comps, ids = (batch.column(c).to_pylist() for c in ("kind", "comp", "set_id"))
            column = batch.column("point")
            for i, name in enumerate(names):
                if name != current:
                    if best:
                        yield close()
                    current, index, tree = name, [], None
                point = np.frombuffer(column[i].as_buffer(), "<u2")
                if kinds[i] < 2:
                    index.append((kinds[i], comps[i], ids[i], point.copy()))
                    continue
                if not index:
                    continue
                tree = tree or Tree([x[3] for x in index], threshold)
                fine = _occurrences(point)
                for j in tree.search(point).tolist():
                    kind, comp, other, _ = index[j]
                    if comp == comps[i] or kind == 1 and other > ids[i]:  # the other is searched for, too
                        continue
                    spare = tree.spare(fine, j)
                    if spare < 0:
                        continue
                    key = (min(comp, comps[i]), max(comp, comps[i]))
                    found = best.setdefault(key, [])
                    heapq.heappush(found, (spare, *sorted((other, ids[i]))))
                    if len(found) > tries:
                        heapq.heappop(found)
                        more.add(key)
        yield close()

    rows = rows.join(shared.likely(held.select("set_id", "point"), "set_id", rows.select("set_id")), "set_id").select("top", "band", "block", "kind", "comp", "set_id", "point")
    dealt = rows.repartition("top", "band", "block").sortWithinPartitions("top", "band", "block", "kind")
    return dealt.mapInArrow(work, "a long, b long, more boolean")


def _meetings(met: DataFrame, roots: DataFrame, unsettled: DataFrame | None, threshold: Fraction, chunk: int) -> DataFrame:
    """The rows of _searched: classes that meet at a shingle where several components do, by the largest component there. Of
    sizes that can be linked, they are in one or in neighbouring bands. Classes that have too few shingles at which they meet
    other components go, and so do components that are not among the unsettled ones (comp), if these are given."""
    ratio = float(np.log(1 / float(threshold)))
    band = F.floor(F.log(F.col("n").cast("double")) / ratio).cast("int")
    rows = met.select("token", "set_id", "n").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    rows = rows.select("token", "set_id", "n", F.coalesce("root", "set_id").alias("comp"))
    if unsettled is not None:
        rows = rows.join(unsettled, "comp", "left_semi")
    open_ = rows.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("token")
    rows = shared.cut(rows.join(open_, "token").select("token", "set_id", "n", "comp"))
    able = rows.groupBy("set_id").agg(F.count("*").alias("k"), F.min("n").alias("m")).filter(F.col("k") >= _enough(threshold, F.col("m"))).select("set_id")
    rows = rows.join(able, "set_id").select("token", "set_id", "comp", F.explode(F.array(band, band + 1)).alias("band"))
    counted = rows.groupBy("token", "band", "comp").agg(F.count("*").alias("m"))
    largest = counted.groupBy("token", "band").agg(F.max_by("comp", F.struct("m", "comp")).alias("top"), F.count("*").alias("comps")).filter("comps > 1")
    rows = shared.cut(rows.join(largest.select("token", "band", "top"), ["token", "band"]).select("top", "band", "set_id", "comp").distinct())
    blocks = rows.groupBy("top", "band").agg(F.ceil(F.count("*") / chunk).cast("int").alias("blocks"))
    rows = rows.join(blocks, ["top", "band"]).withColumn("outside", (F.col("comp") != F.col("top")).cast("int"))
    own = F.pmod(F.xxhash64(F.lit(7), "set_id"), F.col("blocks")).cast("int")
    index = rows.select("top", "band", own.alias("block"), F.col("outside").alias("kind"), "comp", "set_id")
    asked = rows.filter("outside = 1").select("top", "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(2).alias("kind"), "comp", "set_id")
    return index.unionByName(asked)


def _links(keyed: DataFrame, sizes: DataFrame, size: int, threshold: Fraction, chunk: int, frequent: int, tries: int) -> DataFrame | None:
    """node, root: the component of every class that is linked with another; None if there are no links."""
    often = sizes.filter(F.size("often") > 0).select(F.explode(F.arrays_zip("often", "counts")).alias("x")).select("x.*")
    often = shared.cut(often.groupBy("often").agg(F.sum("counts").alias("n")))
    total = often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # at most ``frequent`` shingles can have that many of all counts
    drawn = often.filter(F.col("n") * frequent >= total).orderBy("often").toArrow()
    late = drawn.column("often").to_numpy().view(np.uint64)
    pieces = np.ceil(drawn.column("n").to_numpy() * (frequent / max(1, total))).astype(np.int32)
    order = np.argsort(late)
    late, pieces = late[order], pieces[order]

    # dealt once: what follows needs the rows of a shingle's piece together. Of the classes there that one can be linked with, if
    # any, the next smaller or the next larger is one
    at = Window.partitionBy("token", "piece")
    by_size = at.orderBy("n")
    shown = _shown(keyed, size, threshold, late, pieces).repartition("token", "piece").dropDuplicates(["token", "piece", "set_id"])
    shown = shown.withColumn("smaller", F.lag("n").over(by_size)).withColumn("larger", F.lead("n").over(by_size)).withColumn("crowd", F.count("*").over(at))
    near = [F.col(c).isNotNull() & _fits(threshold, "n", c) for c in ("smaller", "larger")]
    first = shown.filter((F.col("piece") > 0) | near[0] | near[1]).select("token", "piece", "set_id", "n", "crowd")
    of = Window.partitionBy("set_id")
    first = first.withColumn("k", F.count("*").over(of)).withColumn("weight", F.sum("crowd").over(of))
    met = shared.written(first.filter(F.col("k") >= _enough(threshold, F.col("n"))).select("token", "piece", "set_id", "n", "weight"), "met")
    held = shared.written(_held(keyed, sizes, met.select("set_id").distinct(), size), "held")

    # the centre of a shingle's piece is the class there that meets most others at all of its shingles
    centre = F.max(F.struct("weight", "set_id", "n")).over(at)
    near = met.withColumn("c", centre).select(F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("c.set_id").alias("b"), F.col("c.n").alias("nb"))
    near = near.filter(F.col("a") != F.col("b")).filter(_fits(threshold)).groupBy("a", "b").agg(F.count("*").alias("k"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("k"), "b"))
    tested = shared.cut(near.withColumn("place", place).filter("place <= 2").select("a", "b"))
    links = shared.cut(_verified(tested, held, size, threshold))
    roots = shared.cut(components.connected(links))
    unsettled = None
    while True:
        rows = shared.cut(_meetings(met, roots, unsettled, threshold, chunk))
        found = shared.cut(_searched(rows, held, threshold, tries))
        pairs = shared.cut(found.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"))
        new = shared.cut(_verified(pairs, held, size, threshold))
        if not new.isEmpty():
            links = links.unionAll(new)
            roots = shared.cut(components.connected(links))
        # of two components without more pairs every pair that can be linked is tested
        more = found.filter("more").select("a", "b").distinct()
        for c in ("a", "b"):
            more = more.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left").withColumn(c, F.coalesce(f"{c}_root", c)).drop(f"{c}_root")
        unsettled = shared.cut(more.filter("a <> b").select(F.explode(F.array("a", "b")).alias("comp")).distinct())
        if unsettled.isEmpty():
            shared.dropped(met, held)
            return roots
        tested = shared.cut(tested.unionAll(pairs))
        tries *= 16


def link(
    docs: DataFrame, size: int = 5, threshold: Fraction = Fraction(3, 4), doc_id: str = "doc_id", text: str = "text",
    chunk: int = 1024, frequent: int = 1_000_000, tries: int = 256,
) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links lead to); and the row's key, a hash
    of id and text, and its component's key (null for an empty set), which tell rows of one id, or of none, apart."""
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(doc_id, text).alias(_KEY))
    sizes = shared.written(_sizes(keyed, size), "set-sizes")
    roots = _links(keyed, sizes, size, threshold, chunk, frequent, tries)
    classes = sizes.filter("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("least")).join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    classes = shared.cut(classes.select("set_id", "least", F.coalesce("root", "set_id").alias("root")))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "root").select("set_id", "root", "component_id")
    full = sizes.filter("n > 0").select("doc_id", "n", _KEY, "set_id").join(named, "set_id")
    out = full.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col(_KEY).alias("row_key"), F.col("root").alias("component_key"))
    bare = sizes.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col(_KEY).alias("row_key"), F.lit(None).cast("long").alias("component_key"))
    return out.unionAll(bare)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each component: that of the smallest doc_id. Documents without words all stay; of equal
    rows one stays. All columns are kept."""
    linked = shared.cut(link(docs, **options))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    kept = linked.filter("component_key IS NOT NULL").groupBy("component_key").agg(F.min(first).alias("x")).select(F.col("x.row_key").alias(_KEY))
    kept = kept.unionAll(linked.filter("component_key IS NULL").select(F.col("row_key").alias(_KEY)))
    out = docs.withColumn(_KEY, F.xxhash64(options.get("doc_id", "doc_id"), options.get("text", "text"))).join(kept.distinct(), _KEY, "left_semi")
    twice = linked.filter("component_key IS NOT NULL").groupBy("row_key").count().filter("count > 1")
    if not twice.isEmpty():  # equal rows
        equal = out.join(twice.select(F.col("row_key").alias(_KEY)), _KEY, "left_semi").dropDuplicates([_KEY])
        out = out.join(twice.select(F.col("row_key").alias(_KEY)), _KEY, "left_anti").unionByName(equal)
    return out.drop(_KEY)
