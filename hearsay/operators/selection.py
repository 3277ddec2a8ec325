"""Which reviews still need labels, what is stored already, and the newest of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.operators.aggregates import on_version


def unlabeled(reviews: DataFrame, envelopes: DataFrame, failures: DataFrame) -> DataFrame:
    """Reviews with neither an envelope nor a failure mark under the version triple."""
    done = envelopes.filter(on_version()).select("review_id")
    return reviews.join(done, "review_id", "left_anti").join(failures.select("review_id"), "review_id", "left_anti")


def members_unlabeled(members: DataFrame, envelopes: DataFrame, failures: DataFrame) -> DataFrame:
    """Members of a sample that are still owed a label."""
    return unlabeled(members, envelopes, failures)


def new_rows(stored: DataFrame, arriving: DataFrame, key: str) -> DataFrame:
    """Arriving rows whose key isn't stored: what an idempotent ingest appends."""
    return arriving.join(stored.select(key), key, "left_anti")


def conflicts(stored: DataFrame, arriving: DataFrame, key: str, body: str) -> DataFrame:
    """Keys that are stored with another body; the first write wins, a differing one is an error of the writer."""
    theirs = arriving.select(key, F.col(body).alias("arriving_body"))
    return stored.select(key, F.col(body).alias("stored_body")).join(theirs, key).filter(~F.col("stored_body").eqNullSafe(F.col("arriving_body")))


def newest_per_key(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in an order that leaves no ties."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_rn = 1").drop("_rn")


def top_per_key(rows: DataFrame, keys: list[str], n: int, *order: Column, rank: str = "rank") -> DataFrame:
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def numbered(rows: DataFrame, keys: list[str], place: str = "_place", ranges: int = 100) -> DataFrame:
    """rows with their place, from 0, in the order of keys (ascending, distinct, no nulls).

    Rows are numbered within ranges, whose bounds are keys of a bounded sample of smallest hash, and each range starts where
    the ranges before it end: no task sorts all rows, and the same rows give the same places.
    """
    key = F.struct(*keys)
    drawn = rows.select(*keys).orderBy(F.xxhash64(*keys), *keys).limit(ranges * 20)
    edges = [tuple(r) for r in sorted(map(tuple, drawn.collect()))][10::20]  # of the sample
    kinds = [rows.schema[k].dataType for k in keys]
    bounds = F.array(*(F.struct(*(F.lit(v).cast(t).alias(k) for k, v, t in zip(keys, e, kinds, strict=True))) for e in edges)) if edges else None
    dealt, step = rows.withColumn("_part", F.lit(0)), 1 << len(edges).bit_length() >> 1
    while step:  # a range is found by bisection, a comparison a step; beyond the last bound there is null
        dealt, step = dealt.withColumn("_part", F.col("_part") + F.when(F.get(bounds, F.col("_part") + (step - 1)) <= key, step).otherwise(0)), step >> 1
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("_part").alias("_of"), before.alias("_before"))
    own = dealt.withColumn(place, F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1)
    placed = own.join(F.broadcast(offsets), F.col("_part") == F.col("_of"))
    return placed.withColumn(place, F.col(place) + F.col("_before")).drop("_part", "_of", "_before")


def batches(rows: DataFrame, size: int, partition: str, key: str) -> DataFrame:
    """Consecutive batches of a fixed size within each partition, in the order of a key."""
    placed = numbered(rows, [partition, key])
    first = rows.groupBy(partition).agg(F.count("*").alias("_n"))
    starts = first.select(F.col(partition).alias("_of"), F.coalesce(F.sum("_n").over(Window.orderBy(partition).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    joined = placed.join(starts, placed[partition] == F.col("_of"))
    return joined.withColumn("batch", F.floor((F.col("_place") - F.col("_first")) / size).cast("long")).drop("_of", "_first", "_place")
