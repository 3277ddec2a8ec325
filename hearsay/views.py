"""Domain views over the given tables.

Reviews, label envelopes, mentions and journals are bound once here, so that every query reads
domain names. Nothing is collected or cached; each view is a projection that Catalyst prunes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The version triple whose labels are folded.
VERSION = ("lexicon", "p1", "v2")
#: Fixed values, in the order that breaks ties.
SENTIMENTS = ("positive", "negative", "neutral", "mixed")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per review: review_id, app_id, created_at, language, voted_up, amount."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("review_id"),
        (F.col("o_custkey") % 10).cast("long").alias("app_id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "unknown").otherwise("english").alias("language"),
        (F.col("o_orderstatus") != "F").alias("voted_up"),
    )


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label envelope per review: origin and version triple; reviews without lines are empty envelopes."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("review_id"),
        (F.col("o_custkey") % 10).cast("long").alias("app_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", "investigation").otherwise("survey").alias("origin"),
        F.lit(VERSION[0]).alias("model_version"),
        F.lit(VERSION[1]).alias("prompt_version"),
        F.when(F.col("o_orderkey") % 11 == 0, "v1").otherwise(VERSION[2]).alias("ontology_version"),
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of aspects: review_id, position, aspect, slot, sentiment, evidence."""
    line = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part")
    candidate = F.col("p_size") > 25
    return line.join(part, line.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").cast("string").alias("review_id"),
        F.col("l_linenumber").cast("long").alias("position"),
        F.when(candidate, F.col("p_brand")).otherwise(F.col("p_type")).alias("aspect"),
        F.when(candidate, "candidate").otherwise("pinned").alias("slot"),
        F.when((F.col("l_returnflag") == "R"), "negative")
        .when((F.col("l_returnflag") == "A"), "positive")
        .when(F.col("l_linestatus") == "O", "neutral")
        .otherwise("mixed")
        .alias("sentiment"),
        F.when(F.col("l_linenumber") % 5 != 0, F.col("p_name")).alias("evidence"),
    )


#: The same views for DuckDB.
REVIEWS_SQL = """reviews AS (SELECT CAST(o_orderkey AS VARCHAR) AS review_id, CAST(o_custkey % 10 AS BIGINT) AS app_id,
  CAST(o_orderdate AS TIMESTAMP) AS created_at,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'unknown' ELSE 'english' END AS language,
  o_orderstatus <> 'F' AS voted_up FROM orders)"""
ENVELOPES_SQL = """envelopes AS (SELECT CAST(o_orderkey AS VARCHAR) AS review_id, CAST(o_custkey % 10 AS BIGINT) AS app_id,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'investigation' ELSE 'survey' END AS origin,
  'lexicon' AS model_version, 'p1' AS prompt_version,
  CASE WHEN o_orderkey % 11 = 0 THEN 'v1' ELSE 'v2' END AS ontology_version FROM orders)"""
MENTIONS_SQL = """mentions AS (SELECT CAST(l_orderkey AS VARCHAR) AS review_id, CAST(l_linenumber AS BIGINT) AS position,
  CASE WHEN p_size > 25 THEN p_brand ELSE p_type END AS aspect,
  CASE WHEN p_size > 25 THEN 'candidate' ELSE 'pinned' END AS slot,
  CASE WHEN l_returnflag = 'R' THEN 'negative' WHEN l_returnflag = 'A' THEN 'positive'
       WHEN l_linestatus = 'O' THEN 'neutral' ELSE 'mixed' END AS sentiment,
  CASE WHEN l_linenumber % 5 <> 0 THEN p_name END AS evidence
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
