"""Queries over classifier replies, made from mentions with spellings, wrappings and damages on purpose."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearsay import views
from hearsay.operators import replies
from hearsay.views import MENTIONS_SQL


def _asked(spark, sf_dir):
    m = views.mentions(spark, sf_dir).withColumn("r", F.col("review_id").cast("long"))
    return m.withColumn("batch", F.floor(F.col("r") / 10).cast("long")).withColumn("idx", F.col("r") % 10)


def texts(spark, sf_dir):
    pieces = F.array_sort(F.collect_list(F.struct("position", "evidence")))
    joined = F.array_join(F.transform(pieces, lambda x: x["evidence"]), " / ")
    return _asked(spark, sf_dir).groupBy("batch", "idx").agg(joined.alias("text"))


def made(spark, sf_dir):
    """batch, size, reply."""
    m = _asked(spark, sf_dir).repartition("batch")  # texts of a batch, and batches, are put together where they are
    aspect = F.when(F.col("position") % 3 == 0, F.upper("aspect")).when(F.col("position") % 3 == 1, F.replace("aspect", F.lit(" "), F.lit("_"))).otherwise(F.col("aspect"))
    sentiment = F.when(F.col("r") % 31 == 7, F.lit("angry")).otherwise(F.col("sentiment"))
    evidence = F.when(F.col("position") % 4 == 1, F.lit("")).when(F.col("position") % 4 == 2, F.concat("evidence", F.lit("x"))).otherwise(F.col("evidence"))
    item = F.struct("position", F.struct(aspect.alias("aspect"), sentiment.alias("sentiment"), evidence.alias("evidence")).alias("item"))
    rows = m.groupBy("batch", "idx").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"]).alias("aspects"))
    one = F.struct("idx", "aspects")
    whole = rows.groupBy("batch").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("t"))
    reply = (
        F.when(F.col("batch") % 11 == 6, F.lit('{"a": 1}')).when(F.col("batch") % 13 == 8, F.lit("no json [here"))
        .when(F.col("batch") % 7 == 3, F.concat(F.lit("Here it is:\n```json\n"), "t", F.lit("\n```\nDone [1]")))
        .when(F.col("batch") % 7 == 5, F.concat(F.lit("Sure. "), "t", F.lit(" Hope this helps [1"))).otherwise(F.col("t"))
    )
    return whole.select("batch", F.lit(10).alias("size"), reply.alias("reply"))


def vocabulary(spark, sf_dir):
    p = views.table(spark, sf_dir, "part").filter("p_size <= 25").select(F.col("p_type").alias("label")).distinct()
    return p.select("label", F.array(F.replace("label", F.lit(" "), F.lit("-"))).alias("aliases"))


def _parsed(spark, sf_dir):
    return replies.parsed(made(spark, sf_dir), texts(spark, sf_dir), replies.surface_index(vocabulary(spark, sf_dir)))


def reply_mentions(spark, sf_dir):
    m = _parsed(spark, sf_dir)[0]
    return m.groupBy("slot", "aspect", "sentiment").agg(F.count("*").alias("n"), F.count("evidence").alias("with_evidence"))


def reply_failures(spark, sf_dir):
    return _parsed(spark, sf_dir)[1].groupBy("reason").agg(F.count("*").alias("n"), F.count("idx").alias("with_idx"))


def reply_repairs(spark, sf_dir):
    return _parsed(spark, sf_dir)[2].groupBy("aspect").agg(F.count("*").alias("n"), F.min("evidence").alias("first"))


def surfaces(spark, sf_dir):
    """Keys of part names' words as labels, with other labels' keys among their aliases on purpose: how they collide."""
    p = views.table(spark, sf_dir, "part").filter("p_partkey % 3 = 0")
    label = F.concat("p_type", F.lit("_"), (F.col("p_partkey") % 2).cast("string"))
    v = p.select(label.alias("label"), F.array(F.lower("p_brand"), F.replace("p_type", F.lit(" "), F.lit("-"))).alias("aliases")).distinct()
    return replies.collisions(v).select("key", F.size("labels").alias("n"), F.element_at("labels", 1).alias("first"))


def provider_usage(spark, sf_dir):
    """Provider bodies made from events in two spellings, read back and added up."""
    e = views.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 1000 + 10).alias("p"), (F.col("event_id") % 1300).alias("c"), (F.col("event_id") % 77).alias("o"), (F.col("event_id") % 13).alias("t"))
    one = F.to_json(F.struct(F.struct(F.col("p").alias("promptTokenCount"), F.col("c").alias("cachedContentTokenCount"), F.col("o").alias("candidatesTokenCount"), F.col("t").alias("thoughtsTokenCount")).alias("usageMetadata")))
    details = F.struct(F.col("c").alias("cached_tokens")).alias("prompt_tokens_details")
    other = F.to_json(F.struct(F.struct(F.col("p").alias("prompt_tokens"), (F.col("o") + F.col("t")).alias("completion_tokens"), details, F.struct(F.col("t").alias("reasoning_tokens")).alias("completion_tokens_details")).alias("usage")))
    bodies = e.select((F.col("event_id") % 5).alias("kind"), F.when(F.col("event_id") % 2 == 0, one).otherwise(other).alias("body"))
    u = replies.usage(bodies)
    return u.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("prompt", "cached", "output", "thinking")])


def retry_ladder(spark, sf_dir):
    """Attempts made from events: what is owed another one, by step."""
    e = views.table(spark, sf_dir, "events")
    o = e.select((F.col("user_id")).alias("batch"), (F.col("event_id") % 10).alias("idx"), (F.floor(F.col("event_id") / 10) % 3).alias("attempt"), (F.col("event_type") != "error").alias("ok"))
    o = o.groupBy("batch", "idx", "attempt").agg(F.bool_or("ok").alias("ok"))
    return replies.next_attempts(o).groupBy("next").agg(F.count("*").alias("n"))


def model_drift(spark, sf_dir):
    """Users whose kind of event is not what it was first."""
    e = views.table(spark, sf_dir, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("at"))
    return replies.first_value_drift(e, "user_id", "event_type", "at")


ASKED = f"""WITH {MENTIONS_SQL}, a AS (SELECT *, CAST(review_id AS BIGINT) AS r, CAST(review_id AS BIGINT) // 10 AS batch, CAST(review_id AS BIGINT) % 10 AS idx FROM mentions),
t AS (SELECT batch, idx, string_agg(evidence, ' / ' ORDER BY position) AS text FROM a GROUP BY 1, 2),
good AS (SELECT * FROM a WHERE batch % 11 <> 6 AND batch % 13 <> 8), fit AS (SELECT * FROM good WHERE r % 31 <> 7),
items AS (SELECT g.*, CASE WHEN slot = 'pinned' THEN aspect ELSE lower(aspect) END AS label, CASE WHEN position % 4 = 1 THEN '' WHEN position % 4 = 2 THEN evidence || 'x' ELSE evidence END AS quote, text FROM fit g JOIN t USING (batch, idx)),
kept AS (SELECT *, CASE WHEN trim(quote) <> '' AND contains(coalesce(text, ''), quote) THEN quote END AS own FROM items)"""

QUERIES = {
    "reply_mentions": reply_mentions, "reply_failures": reply_failures, "reply_repairs": reply_repairs, "surface_collisions": surfaces, "provider_usage": provider_usage,
    "retry_ladder": retry_ladder, "model_drift": model_drift,
}
ORACLE = {
    "reply_mentions": f"""{ASKED}, f AS (SELECT batch, idx, label, min(struct_pack(p := position, s := slot)).s AS slot, CASE WHEN count(DISTINCT sentiment) = 1 THEN min(sentiment) ELSE 'mixed' END AS sentiment, count(own) > 0 AS ev FROM kept GROUP BY 1, 2, 3)
        SELECT slot, label AS aspect, sentiment, count(*) AS n, count(*) FILTER (ev) AS with_evidence FROM f GROUP BY 1, 2, 3""",
    "reply_failures": f"""{ASKED}, b AS (SELECT DISTINCT batch FROM a), w AS (SELECT CASE WHEN batch % 11 = 6 THEN 'not a JSON array' ELSE 'not valid JSON' END AS reason FROM b, range(10) WHERE batch % 11 = 6 OR batch % 13 = 8),
        m AS (SELECT 'missing' AS reason FROM b CROSS JOIN range(10) n(i) WHERE batch % 11 <> 6 AND batch % 13 <> 8 AND NOT EXISTS (SELECT 1 FROM a WHERE a.batch = b.batch AND a.idx = i)), s AS (SELECT DISTINCT batch, idx FROM good WHERE r % 31 = 7)
        SELECT reason, count(*) AS n, count(*) AS with_idx FROM (SELECT reason FROM w UNION ALL SELECT reason FROM m UNION ALL SELECT 'unknown sentiment' FROM s) GROUP BY 1""",
    "reply_repairs": f"{ASKED} SELECT label AS aspect, count(*) AS n, min(quote) AS first FROM kept WHERE trim(quote) <> '' AND own IS NULL GROUP BY 1",
    "surface_collisions": r"""WITH v AS (SELECT DISTINCT p_type || '_' || (p_partkey % 2) AS label, lower(p_brand) AS a, replace(p_type, ' ', '-') AS b FROM part WHERE p_partkey % 3 = 0), s AS (SELECT label, unnest([label, a, b]) AS f FROM v),
        k AS (SELECT label, trim(regexp_replace(regexp_replace(lower(f), '[_-]+', ' ', 'g'), '\s+', ' ', 'g')) AS key FROM s) SELECT key, count(DISTINCT label)::INT AS n, min(label) AS first FROM k GROUP BY 1 HAVING count(DISTINCT label) > 1""",
    "provider_usage": """SELECT event_id % 5 AS kind, sum(event_id % 1000 + 10)::BIGINT AS prompt, sum(least(event_id % 1300, event_id % 1000 + 10))::BIGINT AS cached, sum(event_id % 77)::BIGINT AS output, sum(event_id % 13)::BIGINT AS thinking FROM events GROUP BY 1""",
    "retry_ladder": """WITH o AS (SELECT user_id AS batch, event_id % 10 AS idx, (event_id // 10) % 3 AS attempt, bool_or(event_type <> 'error') AS ok FROM events GROUP BY 1, 2, 3), l AS (SELECT batch, idx, max_by(ok, attempt) AS ok, max(attempt) AS attempt FROM o GROUP BY 1, 2)
        SELECT CASE attempt WHEN 0 THEN 'rebatch' ELSE 'isolate' END AS next, count(*) AS n FROM l WHERE NOT ok AND attempt < 2 GROUP BY 1""",
    "model_drift": """WITH f AS (SELECT *, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pinned FROM events)
        SELECT user_id, any_value(pinned) AS pinned, arg_min(event_type, struct_pack(a := ts, b := event_id)) AS drifted FROM f WHERE event_type <> pinned GROUP BY 1""",
}
