"""Mixing sources to target weights by Sainte-Lague apportionment (operator 4).

Sources, by code point with null last, weigh 5, 2, 1 and so on again. Their targets share the size of all documents
by weight; no target passes ``cap`` times its source's size, and what it would have had over that is shared again.

The mix is made of equal blocks of words. Sainte-Lague (the highest quotients target / (2k + 1)) gives each source
whole blocks up to its target, then each shard of the source whole blocks by the shard's size; what stays below a block is
given out again in blocks of one word, so that a source smaller than a block has its target too. A shard is a seeded hash share of the
source's documents, small enough for one task, so a source with a third of all rows is spread over many tasks.
In a shard, documents in seeded order form a stream of words, whose blocks are taken from the start, and over again when
the quota is more than the stream; a shard that is given all it may give leaves the next block to the others. A document at the edge is taken in part; none is taken more than ``cap`` times.

Only one row per source, and one per shard of a source, is ever in one group. Reruns give the same rows.

Edge cases: null or empty texts have size 0 and nothing is taken of them; documents of a null source form a source;
repeated rows are documents of their own (ties in place go by doc_id and size); a null size counts as 0; a document of any
length is one row of its size; an empty table gives an empty one. Extra columns are kept, whatever their names, but those
named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.llm import shared

#: Fixed value: what a word is.
WORD = r"[^\x20\x09-\x0D]+"
_OWN = "_hearsay_mix_"


def word_count(text: str = "text") -> Column:
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray | None = None) -> np.ndarray:
    """Seats by highest quotients votes / (2k + 1), ties to the earlier; found by bisecting the divisor. One that has as many
    seats as it can have (``most``) leaves the next to the others."""
    votes = np.asarray(votes, np.float64)
    given = np.zeros(len(votes), np.int64)
    most = np.full(len(votes), np.iinfo(np.int64).max) if most is None else np.where(votes > 0, most, 0).astype(np.int64)
    seats = min(int(seats), int(most[votes > 0].sum())) if (votes > 0).any() and most.max() < np.iinfo(np.int64).max else int(seats)
    if seats <= 0 or not (votes > 0).any():
        return given
    low, high = 0.0, 1.0  # quotients per seat: more seats than asked for at low's side
    scale = votes.max()

    def at(x: float) -> np.ndarray:
        return np.minimum(np.floor(votes * x / scale + 0.5), most).astype(np.int64)

    while at(high).sum() < seats:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if at(middle).sum() > seats:
            high = middle
        else:
            low = middle
    given = at(low)
    while (short := seats - int(given.sum())) > 0:  # seats at one and the same quotient: to the earlier
        quotients = np.where(given < most, votes / (2 * given + 1), -1.0)
        best = np.argsort(-quotients, kind="stable")[:short]
        best = best[quotients[best] >= quotients[best[0]] * (1 - 1e-12)]
        given[best] += 1
    return given


def quotas(shares: np.ndarray, words: int, block: int, most: np.ndarray) -> np.ndarray:
    """Words for each share: whole blocks as far as a share holds them, then one-word blocks by what is left of the shares."""
    shares = np.asarray(shares, np.float64)
    whole = sainte_lague(shares, words // block, np.floor(shares / block)) * block
    return whole + sainte_lague(shares - whole, words - int(whole.sum()), np.maximum(most - whole, 0))


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """sizes: source, source_size -> and target. One row per source, so windows over all of them stay small."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), place + 1)
    rows = sizes.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    total = F.sum("source_size").over(every).cast("double")
    # sources fill up in the order of most / weight; one is full if its share of what earlier full ones left is too much
    filling = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = filling.rowsBetween(Window.unboundedPreceding, -1)
    left = total - F.coalesce(F.sum("most").over(earlier), F.lit(0.0))
    weights_left = F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("full", F.col("most") <= F.col("weight") * left / weights_left).withColumn("total", total)
    full_most = F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(every), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    share = F.col("weight") * (F.col("total") - full_most) / open_weight
    return rows.select("source", "source_size", "n_docs", F.when(F.col("full"), F.col("most")).otherwise(share).alias("target"))


def mix(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: float = 3.0, block: int = 8, seed: int = 17,
    shard_words: int = 1_000_000, shard_docs: int = 2048,
) -> DataFrame:
    """docs (doc_id, source, size, ...) with source_size, target (of its source) and taken (words the mix takes)."""
    made = ("source_size", "target", "taken")
    docs = shared.cut(docs.drop(*made).withColumn("size", F.coalesce(F.col("size"), F.lit(0)).cast("long")))
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))

    def source_blocks(sources: pd.DataFrame) -> pd.DataFrame:
        sources = sources.sort_values("source", na_position="last", kind="stable")
        target = sources["target"].to_numpy()
        return sources.assign(words=quotas(target, round(float(target.sum())), block, np.floor(cap * sources["source_size"].to_numpy())))

    schema = "source string, source_size long, n_docs long, target double, words long"
    planned = targets(sizes, weights, cap).groupBy().applyInPandas(source_blocks, schema)
    shards = F.ceil(F.greatest(F.col("source_size") / shard_words, F.col("n_docs") / shard_docs, F.lit(1.0))).cast("int")
    # names of its own, which none of the documents' columns can have
    of, shard, size, quota, words = (f"{_OWN}{c}" for c in ("of", "shard", "size", "quota", "words"))
    planned = shared.cut(planned.select(F.col("source").alias(of), "source_size", "target", F.col("words").alias(words), shards.alias(f"{_OWN}shards")))

    dealt = docs.join(planned, docs["source"].eqNullSafe(planned[of])).drop(of)
    place = F.xxhash64(F.lit(seed), "doc_id", "size")  # documents of one id, or of none, are dealt by their size
    dealt = dealt.withColumn(shard, F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "size"), F.col(f"{_OWN}shards")).cast("int"))
    cells = dealt.groupBy("source", F.col(shard).alias("shard")).agg(F.sum("size").alias("cell_size"), F.first(words).alias("words"))

    def cell_words(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("shard")
        sizes, words = cells["cell_size"].to_numpy(), int(cells["words"].iloc[0])
        shares = sizes * (words / max(sizes.sum(), 1))
        return cells[["source", "shard", "cell_size"]].assign(quota=quotas(shares, words, block, np.floor(cap * sizes)))

    dealt_words = cells.groupBy("source").applyInPandas(cell_words, "source string, shard int, cell_size long, quota long")
    dealt_words = dealt_words.select(F.col("source").alias(of), F.col("shard").alias(f"{_OWN}in"), F.col("cell_size").alias(size), F.col("quota").alias(quota))
    joined = dealt.join(dealt_words, dealt["source"].eqNullSafe(dealt_words[of]) & (dealt[shard] == dealt_words[f"{_OWN}in"]))
    stream = Window.partitionBy("source", shard).orderBy(place, "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(stream), F.lit(0))
    whole = F.floor(F.col(quota) / F.nullif(F.col(size), F.lit(0)))
    rest = F.col(quota) - whole * F.col(size)
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return joined.withColumn("taken", F.coalesce(taken, F.lit(0)).cast("long")).select(*docs.columns, *made)


def mixed(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix itself: each document of docs (doc_id, source, text, ...) as often as the mix takes it, rounded.

    Only one document of a shard can be taken in part; documents without words are not in a mix.
    """
    key, times, rows_, turn = (f"{_OWN}{c}" for c in ("key", "times", "rows", "turn"))
    rows = docs.withColumn(key, F.xxhash64("doc_id", F.col(text)))
    sizes = rows.select("doc_id", "source", word_count(text).alias("size"), key)
    taken = mix(sizes, **options).filter("taken > 0").select(key, F.round(F.col("taken") / F.col("size")).cast("int").alias(times))
    # equal rows of one id share a key: together they occur as often as each of them is taken
    taken = taken.filter(F.col(times) > 0).groupBy(key).agg(F.sum(times).alias(times), F.count("*").alias(rows_))
    out = rows.join(taken.filter(F.col(rows_) == 1), key)
    several = taken.filter(F.col(rows_) > 1)
    if not several.isEmpty():
        out = out.unionByName(rows.join(several, key).dropDuplicates([key]))
    return out.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*docs.columns)
