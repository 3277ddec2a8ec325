"""Merkle manifests of a dataset, a tree per group and a tree over the groups' roots (operator 11).

Method: checkpoint and recompute. Every ARITY consecutive nodes have one parent; only every STRIDE-th level is stored, as
Parquet. Proofs go from the top down: each aligned subtree is regrouped from its stored descendants, its missing interior
nodes are computed again, every descendant gets its siblings, and the interior nodes are dropped with the row.

A node's digest H is the lowercase hex sha256 of its children's digests, concatenated as text. The leaves of a group ascend by
the given order (nulls first, equal ones by their digest); the last run of a level may be shorter, even one node. What remains
is the group's subroot; subroots in the order of their groups (null first, bytewise) give the root in the same way.

Rows are dealt by ranges of (group, order, digest) once, without their texts, and their place is the number that they have in
their range plus what the ranges before hold of their group: a group with any share of all rows is spread over many tasks.
No task ever holds more than one subtree, of ARITY ** STRIDE nodes. Everything is DataFrame operations; levels are tables in
the shared folder, so a lost executor repeats its own tasks only.

Edge cases: a null value in a leaf is ``-``, so it differs from an empty text; a null group is a group of its own; rows of an
equal order value go by their digest, and equal rows are a leaf each, with equal digests and proofs of their own; a lone leaf
is its subroot; texts are hashed whole; extra columns are carried along; an empty table has no rows and no root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.llm import shared

ARITY, STRIDE = 8, 2
#: Descendants of a stored node at the stored level below it.
SPAN = ARITY**STRIDE
_BITS = SPAN.bit_length() - 1
#: One level of a proof: the digests of the run's others, left and right of the node.
STEP = "struct<before: string, after: string>"


def hashed(*parts: Column) -> Column:
    """H of digests or texts."""
    return F.sha2(F.concat(*parts), 256)


def leaf(*values: str | Column) -> Column:
    """H of a row's values: each ``-`` if null, else its number of UTF-8 bytes, a colon and the value."""
    texts = [(F.col(v) if isinstance(v, str) else v).cast("string") for v in values]
    return hashed(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def _fewer(n: int) -> int:
    """Nodes of a tree one stored level up, of n here."""
    return 1 if n <= ARITY else -(-n // SPAN)


@dataclass
class Forest:
    """levels[i]: stored nodes (tree, n, place, digest), n being those of the tree at that level; in the last a tree has one.
    The nodes of levels[0] carry the columns of their rows."""

    levels: list[DataFrame]

    def roots(self) -> DataFrame:
        return self.levels[-1].select("tree", "digest")


def _subtrees(level: DataFrame) -> DataFrame:
    """Aligned subtrees of a stored level: tree, n, parent (its place one stored level up), nodes, digests and interior: what
    is missing between, computed again."""
    rest = [c for c in level.columns if c not in ("tree", "n")]
    nodes = F.array_sort(F.collect_list(F.struct("place", *[c for c in rest if c != "place"])), lambda a, b: F.signum(a["place"] - b["place"]).cast("int"))
    grouped = level.groupBy("tree", "n", F.shiftright("place", _BITS).alias("parent")).agg(nodes.alias("nodes"))
    digests = grouped.withColumn("digests", F.col("nodes.digest"))
    runs = F.sequence(F.lit(0), F.floor((F.size("digests") - 1) / ARITY).cast("int"))
    return digests.withColumn("interior", F.transform(runs, lambda r: F.sha2(_joined(F.slice("digests", r * ARITY + 1, ARITY)), 256)))


def _up(level: DataFrame) -> DataFrame:
    n = F.col("n")
    digest = F.when(n == 1, F.col("digests")[0]).when(n <= ARITY, F.col("interior")[0]).otherwise(F.sha2(_joined(F.col("interior")), 256))
    return _subtrees(level.select("tree", "n", "place", "digest")).select(
        "tree", F.when(n <= ARITY, F.lit(1)).otherwise(F.ceil(n / SPAN)).cast("long").alias("n"), F.col("parent").alias("place"), digest.alias("digest")
    )


def grow(leaves: DataFrame, order: list[str]) -> Forest:
    """The stored levels over leaves: tree, digest, and columns that are carried along."""
    keys = [F.col("tree"), *(F.col(c).asc_nulls_first() for c in order), F.col("digest")]
    dealt = leaves.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    kept = shared.written(dealt, "merkle-leaves")
    # a row for each group in each range: within a group as many as there are ranges
    part = F.shiftright("_at", 33)
    runs = kept.groupBy("tree", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(tree).alias("n"))
    runs = shared.written(runs, "merkle-ranges")
    level = kept.withColumn("_part", part).join(runs, ["tree", "_part"]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")
    levels, most = [level], runs.agg(F.max("n")).first()[0] or 1
    while most > 1:
        levels.append(shared.written(_up(levels[-1]), f"merkle-level-{STRIDE * len(levels)}"))
        most = _fewer(most)
    return Forest(levels)


def _down(level: DataFrame, above: DataFrame) -> DataFrame:
    """The nodes of a stored level with their paths to the top. above: tree, place, path and what else all nodes below carry."""
    down = _subtrees(level).join(above.withColumnRenamed("place", "parent"), ["tree", "parent"])
    carried = [c for c in above.columns if c not in ("tree", "place", "path")]
    each = down.select("tree", "n", "digests", "interior", "path", *carried, F.posexplode("nodes").alias("_i", "_node"))
    run, at = F.floor(F.col("_i") / ARITY).cast("int"), (F.col("_i") % ARITY).cast("int")

    def step(row: str, first: Column, place: Column) -> Column:
        """The others of a run that starts at an index of a row of nodes."""
        return F.struct(
            _joined(F.slice(row, first + 1, place)).alias("before"), _joined(F.slice(row, first + place + 2, ARITY - 1 - place)).alias("after")
        )

    own, over = step("digests", run * ARITY, at), step("interior", F.lit(0), run)
    steps = F.when(F.col("n") == 1, F.array().cast(f"array<{STEP}>")).when(F.col("n") <= ARITY, F.array(own)).otherwise(F.array(own, over))
    return each.select("tree", F.concat(steps, "path").alias("path"), *carried, "_node.*")


def _paths(forest: Forest, tops: DataFrame) -> DataFrame:
    """The leaves of a forest with their paths; tops: tree, path and carried columns, a row a tree."""
    nodes = tops.withColumn("place", F.lit(0).cast("long"))
    for level in reversed(forest.levels[:-1]):
        found = _down(level, nodes)
        nodes = found if level is forest.levels[0] else found.drop("digest")
    if len(forest.levels) == 1:
        nodes = forest.levels[0].join(tops, "tree").drop("n")
    return nodes.drop("place")


@dataclass
class Manifest:
    groups: Forest
    top: Forest

    def root(self) -> DataFrame:
        """One row: root; none for an empty table."""
        return self.top.roots().select(F.col("digest").alias("root"))

    def proofs(self) -> DataFrame:
        """Every leaf with its carried columns, digest, path (STEP by level, through the subroot to the root), subroot, root."""
        start = self.top.roots().select("tree", F.col("digest").alias("root"), F.array().cast(f"array<{STEP}>").alias("path"))
        subroots = _paths(self.top, start).select(F.col("group").alias("tree"), F.col("digest").alias("subroot"), "root", "path")
        return _paths(self.groups, subroots).drop("tree")


def build(rows: DataFrame, digest: Column, group: str, order: list[str], carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of rows whose leaves are ``digest``; order and carry are kept with the leaves, other columns are left out."""
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = rows.select(tree.alias("tree"), digest.alias("digest"), *order, *(c.alias(k) for k, c in (carry or {}).items()))
    groups = grow(leaves, order)
    top = grow(groups.roots().select(F.lit("").alias("tree"), "digest", F.col("tree").alias("group")), ["group"])
    return Manifest(groups, top)


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, digest, lambda acc, s: hashed(s["before"], acc, s["after"]))


def proof_digest(path: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    return F.sha2(_joined(F.transform(path, lambda s: F.concat(s["before"], s["after"]))), 256)
