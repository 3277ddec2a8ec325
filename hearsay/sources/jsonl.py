"""JSON Lines in and out, with declared schemas and counted drops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearsay.functions.text import has_content

#: A review as its source writes it.
REVIEW = T.StructType([
    T.StructField("recommendationid", T.StringType()), T.StructField("language", T.StringType()), T.StructField("review", T.StringType()),
    T.StructField("timestamp_created", T.LongType()), T.StructField("voted_up", T.BooleanType()),
])
_BAD = "_corrupt"


def read_reviews(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Typed reviews of files named <app_id>_reviews.jsonl. A line that is no such record is an error with its file.

    Columns: review_id, app_id (of the file's name), created_at, language, text, voted_up. Blank lines don't count.
    """
    schema = T.StructType([*REVIEW.fields, T.StructField(_BAD, T.StringType())])
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BAD).json(paths)
    file = F.col("_metadata.file_path")
    bad = F.raise_error(F.concat(F.lit("not a review record in "), file, F.lit(": "), _BAD)).cast("string")
    return raw.select(
        F.when(F.col(_BAD).isNotNull(), bad).otherwise(F.col("recommendationid")).alias("review_id"),
        F.regexp_extract(file, r"(\d+)_[^/]*$", 1).cast("long").alias("app_id"),
        F.timestamp_seconds("timestamp_created").alias("created_at"), "language", F.col("review").alias("text"), "voted_up",
    )


def drop_counts(reviews: DataFrame, language: str = "english") -> DataFrame:
    """Per app: total = other_language + empty + usable."""
    own, full = F.col("language").eqNullSafe(F.lit(language)), has_content(F.col("text"))
    return reviews.groupBy("app_id").agg(
        F.count("*").alias("total"), F.count_if(~own).alias("other_language"), F.count_if(own & ~full).alias("empty"), F.count_if(own & full).alias("usable")
    )


def write_lines(rows: DataFrame, folder: str, *order: str) -> None:
    """One JSON object a line, in the given order over all files; nulls are written."""
    columns = rows.columns
    line = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value")
    rows.orderBy(*order).select(line).write.mode("errorifexists").text(folder)


def fingerprint(rows: DataFrame) -> DataFrame:
    """Number of rows and a digest that no order or partition changes: the sum of row hashes."""
    return rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")).cast("string").alias("digest"))
