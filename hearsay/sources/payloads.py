"""JSON payloads of a store's endpoints, read with VARIANT so that numbers, booleans and missing fields are told apart.

Each function takes rows with a column payload (JSON text) and an app_id, and fails with a message on a shape that it does
not know; what the store may leave out is empty or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kind(value: str) -> Column:
    """Kind of a variant expression: BIGINT, BOOLEAN, STRING, ARRAY<...>, OBJECT<...>, VOID; null where there is no field."""
    return F.expr(f"schema_of_variant({value})")


def field(value: str, path: str) -> str:
    return f"try_variant_get({value}, '{path}', 'variant')"


def demand(condition: Column, then: Column, message: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), then).otherwise(F.raise_error(F.lit(message)).cast("string"))


def whole_number(value: str, path: str, context: str) -> Column:
    """The whole number at a path; true is none."""
    ok = kind(field(value, path)) == "BIGINT"
    problem = F.raise_error(F.lit(f"{context}: {path} is no whole number")).cast("long")
    return F.when(F.coalesce(ok, F.lit(False)), F.expr(f"try_variant_get({value}, '{path}', 'bigint')")).otherwise(problem)


def moment(value: str, path: str, context: str) -> Column:
    return F.timestamp_seconds(whole_number(value, path, context)).cast("timestamp_ntz")


def listed(value: str, path: str, context: str, optional: bool) -> Column:
    """The list at a path; one that is missing is empty if it may be."""
    k = F.coalesce(kind(field(value, path)), F.lit("VOID"))
    none = F.array().cast("array<variant>")
    items = F.expr(f"try_cast({field(value, path)} AS array<variant>)")
    problem = F.raise_error(F.lit(f"{context}: {path} is no list")).cast("array<variant>")
    return F.when(k.startswith("ARRAY"), items).when((k == "VOID") & F.lit(optional), none).otherwise(problem)


def _parsed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("v", F.expr("parse_json(payload)"))


def review_pages(rows: DataFrame) -> DataFrame:
    """app_id, success, cursor, total_reviews (null for a summary without it), and reviews, an array that may be empty."""
    r = _parsed(rows)
    review = F.expr("""transform(items, x -> struct(try_variant_get(x, '$.recommendationid', 'string') AS review_id, try_variant_get(x, '$.language', 'string') AS language, try_variant_get(x, '$.review', 'string') AS text,
        timestamp_seconds(try_variant_get(x, '$.timestamp_created', 'bigint')) AS created_at, CASE WHEN schema_of_variant(try_variant_get(x, '$.voted_up', 'variant')) = 'BOOLEAN' THEN try_variant_get(x, '$.voted_up', 'boolean') END AS voted_up))""")
    r = r.withColumn("items", listed("v", "$.reviews", "review page", True)).withColumn("success", whole_number("v", "$.success", "review page"))
    total = F.when(kind(field("v", "$.query_summary.total_reviews")).isNotNull(), whole_number("v", "$.query_summary.total_reviews", "query summary"))
    r = r.select("app_id", "success", F.expr("try_variant_get(v, '$.cursor', 'string')").alias("cursor"), total.alias("total_reviews"), review.alias("reviews"))
    bad = F.exists("reviews", lambda x: x["review_id"].isNull() | x["created_at"].isNull() | x["voted_up"].isNull())
    return r.withColumn("reviews", F.when(~bad, F.col("reviews")).otherwise(F.raise_error(F.lit("review page: a review lacks its id, time or vote")).cast(r.schema["reviews"].dataType)))


def histograms(rows: DataFrame) -> DataFrame:
    """app_id, unit (month or week), rollups and recent (start, up, down), events (kind, start, end)."""
    r = _parsed(rows).withColumn("unit", F.expr("try_variant_get(v, '$.results.rollup_type', 'string')"))
    known = (whole_number("v", "$.success", "histogram") == 1) & F.col("unit").isin("month", "week")
    r = r.withColumn("unit", demand(known, F.col("unit"), "histogram: no success, or a unit that is neither month nor week"))
    for name, path, optional in (("rollups", "$.results.rollups", False), ("recent", "$.results.recent", False), ("events", "$.past_events", True)):
        r = r.withColumn(name, listed("v", path, "histogram", optional))
    bucket = "transform({0}, x -> struct(CAST(timestamp_seconds(try_variant_get(x, '$.date', 'bigint')) AS timestamp_ntz) AS start, try_variant_get(x, '$.recommendations_up', 'bigint') AS up, try_variant_get(x, '$.recommendations_down', 'bigint') AS down))"
    event = "transform(events, x -> struct(try_variant_get(x, '$.type', 'bigint') AS kind, CAST(timestamp_seconds(try_variant_get(x, '$.start_date', 'bigint')) AS timestamp_ntz) AS start, CAST(timestamp_seconds(try_variant_get(x, '$.end_date', 'bigint')) AS timestamp_ntz) AS end))"
    return r.select("app_id", "unit", F.expr(bucket.format("rollups")).alias("rollups"), F.expr(bucket.format("recent")).alias("recent"), F.expr(event).alias("events"))


def compact_histograms(rows: DataFrame) -> DataFrame:
    """The same from records of our own making, whose buckets carry ISO times: app_id, unit, rollups."""
    shape = "struct<rollup_unit:string,rollups:array<struct<start:timestamp_ntz,up:bigint,down:bigint>>>"
    return rows.select("app_id", F.from_json("payload", shape, {"mode": "FAILFAST"}).alias("x")).select("app_id", F.col("x.rollup_unit").alias("unit"), "x.rollups")


def any_histograms(rows: DataFrame) -> DataFrame:
    """Histograms of both shapes: app_id, unit, rollups."""
    own = F.expr("try_variant_get(parse_json(payload), '$.rollup_unit', 'string')").isNotNull()
    # filters can be moved past a demand, so what is not of a shape is shown to its reader as an empty record of it
    empty = F.lit('{"success": 1, "results": {"rollup_type": "month", "rollups": [], "recent": []}}')
    wire = rows.withColumn("_own", own).withColumn("payload", F.when(F.col("_own"), empty).otherwise(F.col("payload"))).filter("NOT _own")
    compact = rows.withColumn("_own", own).withColumn("payload", F.when(F.col("_own"), F.col("payload"))).filter("_own")
    return compact_histograms(compact).unionByName(histograms(wire).select("app_id", "unit", "rollups"))


def search_hits(rows: DataFrame) -> DataFrame:
    """app_id of the request, and of each hit that is an app: hit_id, name, image. Bundles are no apps."""
    r = _parsed(rows).withColumn("items", listed("v", "$.items", "search", True)).select("app_id", F.explode("items").alias("x"))
    r = r.filter(F.expr("try_variant_get(x, '$.type', 'string') = 'app'"))
    name = F.expr("try_variant_get(x, '$.name', 'string')")
    return r.select("app_id", whole_number("x", "$.id", "search item").alias("hit_id"), demand(name != "", name, "search: an app without a name").alias("name"), F.expr("try_variant_get(x, '$.tiny_image', 'string')").alias("image"))


def app_details(rows: DataFrame) -> DataFrame:
    """app_id, name, header_image; no row for an app that the store has no data of. An answer that does not have the app's key
    at all is an error."""
    r = _parsed(rows).withColumn("entries", F.expr("try_cast(v AS map<string, variant>)")).withColumn("key", F.col("app_id").cast("string"))
    there = F.array_contains(F.map_keys("entries"), F.col("key"))
    r = r.withColumn("key", demand(there, F.col("key"), "app details: no answer for the app")).withColumn("e", F.expr("try_element_at(entries, key)"))
    r = r.filter(F.expr("coalesce(try_variant_get(e, '$.success', 'boolean'), false) AND try_variant_get(e, '$.data', 'variant') IS NOT NULL"))
    name = F.expr("try_variant_get(e, '$.data.name', 'string')")
    return r.select("app_id", demand(name != "", name, "app details: no name").alias("name"), F.expr("nullif(try_variant_get(e, '$.data.header_image', 'string'), '')").alias("header_image"))


def provider_replies(rows: DataFrame) -> DataFrame:
    """Answers of two kinds of providers as one: text and finish (stop, length, blocked, other)."""
    r = _parsed(rows)
    text = F.expr("coalesce(try_variant_get(v, '$.candidates[0].content.parts[0].text', 'string'), try_variant_get(v, '$.choices[0].message.content', 'string'))")
    raw = F.lower(F.expr("coalesce(try_variant_get(v, '$.candidates[0].finishReason', 'string'), try_variant_get(v, '$.choices[0].finish_reason', 'string'))"))
    finish = F.when(raw == "stop", "stop").when(raw.isin("length", "max_tokens"), "length").when(raw.isin("safety", "content_filter", "recitation"), "blocked").otherwise("other")
    return r.select(*[c for c in rows.columns if c != "payload"], text.alias("text"), finish.alias("finish"))
