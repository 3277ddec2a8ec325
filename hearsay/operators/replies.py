"""Labels out of classifier replies: decoding, attribution to what was asked, resolution of labels, evidence checks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearsay.functions import text as tx
from hearsay.operators import grounding
from hearsay.views import SENTIMENTS


def surface_index(vocabulary: DataFrame) -> DataFrame:
    """vocabulary (label, aliases) -> key, label: where each spelling leads. A key of several labels is in no index; see
    ``collisions``."""
    return _surfaces(vocabulary).groupBy("key").agg(F.min("label").alias("label"), F.count_distinct("label").alias("n")).filter("n = 1").drop("n")


def _surfaces(vocabulary: DataFrame) -> DataFrame:
    forms = vocabulary.select("label", F.explode(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("surface"))
    return forms.select("label", "surface", tx.match_key("surface").alias("key"))


def collisions(vocabulary: DataFrame) -> DataFrame:
    """Keys that spellings of several labels meet at: key, labels (sorted)."""
    return _surfaces(vocabulary).groupBy("key").agg(F.array_sort(F.collect_set("label")).alias("labels")).filter(F.size("labels") > 1)


def normalized(raw: DataFrame, index: DataFrame, column: str = "aspect") -> DataFrame:
    """raw with aspect and slot: pinned labels by the index, others as candidates in their own form. Labels that are empty
    once folded have neither. raw is read once; a vocabulary is small enough to be sent to all tasks."""
    folded = raw.withColumns({"_key": tx.match_key(column), "_form": tx.candidate_form(column)})
    known = folded.join(index.select(F.col("key").alias("_key"), F.col("label").alias("_label")), "_key", "left")
    some = F.col("_key") != ""
    aspect = F.when(some, F.coalesce("_label", "_form")).alias("aspect")
    slot = F.when(some, F.when(F.col("_label").isNotNull(), "pinned").otherwise("candidate")).alias("slot")
    return known.select(*[c for c in raw.columns if c not in (column, "aspect", "slot")], aspect, slot)


_STRING_OR_BRACKET = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]]', re.DOTALL)


def _pairs(text: str) -> list[tuple[int, int]]:
    """For each square bracket that opens, where it is closed, counting those between that stand outside of JSON strings."""
    found = []
    for opened in (i for i, c in enumerate(text) if c == "["):
        depth = 0
        for token in _STRING_OR_BRACKET.finditer(text, opened):
            depth += {"[": 1, "]": -1}.get(token[0], 0)
            if not depth:
                found.append((opened, token.end()))
                break
    return found


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def bracketed(texts: pd.Series) -> pd.Series:
    """Where square brackets stand, from the left: first character (from 1) and length. Places, not pieces: nested ones would hold a
    text many times over."""
    return texts.map(lambda t: [[a + 1, z - a] for a, z in _pairs(t)], na_action="ignore")


def with_payload(replies: DataFrame) -> DataFrame:
    """replies (..., reply) with payload: the reply itself if it is JSON, else its first fenced block that is, else the first of what
    it has in square brackets that is; null if there is none; and value: the payload as VARIANT. Replies are read once, and only those
    that are no JSON are looked through."""
    json = lambda c: F.call_function("try_parse_json", c)
    read = replies.withColumn("_own", json(F.col("reply")))
    read = read.withColumn("_at", F.coalesce(bracketed(F.when(F.col("_own").isNull(), F.col("reply"))), F.array().cast("array<array<int>>")))
    pieces = F.split("reply", "```", -1)
    blocks = F.filter(F.transform(pieces, lambda p, i: F.struct(i.alias("i"), p.alias("p"))), lambda x: (x["i"] % 2 == 1) & (x["i"] < F.size(pieces) - 1) & x["p"].rlike(r"^[A-Za-z]*\s*\n"))
    bodies = F.transform(blocks, lambda x: F.regexp_replace(x["p"], r"^[A-Za-z]*\s*\n", ""))
    inside = F.transform("_at", lambda x: F.substring("reply", x[0], x[1]))
    found = F.get(F.filter(F.concat(bodies, inside), lambda c: json(c).isNotNull()), 0)
    read = read.withColumn("payload", F.when(F.col("_own").isNotNull(), F.col("reply")).otherwise(found))
    return read.withColumn("value", F.when(F.col("_own").isNotNull(), F.col("_own")).otherwise(json(F.col("payload")))).drop("_own", "_at")


def verdicts(replies: DataFrame) -> DataFrame:
    """replies (batch, size, reply) -> batch, idx, reason, items: a row for each text of a list, each failure and each thing that a list
    has and that was not asked for. items (aspect, sentiment, evidence) in their order, of texts without a reason, which hold
    as a whole. One pass over the replies and one sort by batch and id."""
    got = with_payload(replies)
    lists = got.select("batch", "size", "payload", F.expr("try_cast(value AS array<variant>)").alias("items"))
    trouble = F.when(F.col("items").isNull(), F.when(F.col("payload").isNull(), "not valid JSON").otherwise("not a JSON array"))
    rows = grounding.placed(lists.select("batch", "size", "items", trouble.alias("trouble")))
    ok = F.col("outcome") == "ok"
    listed = rows.withColumn("items", F.when(ok, F.expr("try_cast(aspects AS array<variant>)")))
    parts = F.expr("""transform(items, x -> struct(x, try_variant_get(x, '$.aspect', 'variant') AS a,
        try_variant_get(x, '$.sentiment', 'variant') AS s, try_variant_get(x, '$.evidence', 'variant') AS e))""")
    text = lambda v: f"CASE WHEN schema_of_variant(x.{v}) = 'STRING' THEN try_variant_get(x.{v}, '$', 'string') END"
    read = F.expr(f"""transform(parts, x -> struct({text("a")} AS aspect, {text("s")} AS sentiment, {text("e")} AS evidence,
        x.e IS NULL OR schema_of_variant(x.e) IN ('STRING', 'VOID') AS evidence_ok, x.a IS NOT NULL OR coalesce(schema_of_variant(x.x) LIKE 'OBJECT%', false) AS is_object))""")
    each = listed.withColumn("parts", parts).select("batch", "idx", "outcome", read.alias("items"))
    each = each.withColumn("keys", tx.match_keys(F.transform("items", lambda x: x["aspect"])))
    fault = lambda x, i: (
        F.when(~x["is_object"], "an aspect entry is no object").when(~F.coalesce(F.get("keys", i) != "", F.lit(False)), "an aspect is no label")
        .when(~F.coalesce(x["sentiment"].isin(*SENTIMENTS), F.lit(False)), "unknown sentiment").when(~x["evidence_ok"], "evidence is no text")
    )
    first = F.get(F.filter(F.transform("items", fault), lambda r: r.isNotNull()), 0)
    reason = F.when(~ok, F.col("outcome")).when(F.col("items").isNull(), "aspects is no list").otherwise(first)
    idx = F.when(~F.col("outcome").isin("bad idx", "out of range"), F.col("idx")).alias("idx")
    return each.select("batch", idx, reason.alias("reason"), F.transform("items", lambda x: F.struct(x["aspect"].alias("aspect"), x["sentiment"].alias("sentiment"), x["evidence"].alias("evidence"))).alias("items"))


def found(replies: DataFrame, texts: DataFrame, index: DataFrame) -> DataFrame:
    """All of ``parsed`` in one pass over the replies: batch, idx, kind (mentions, failures or repairs), aspect, slot, sentiment,
    evidence, reason."""
    v = verdicts(replies).join(texts.select("batch", "idx", "text", F.lit(True).alias("here")), ["batch", "idx"], "left")
    v = v.filter("reason IS NOT NULL OR here").select("batch", "idx", "reason", "text", F.posexplode_outer(F.when(F.col("reason").isNull(), F.col("items"))).alias("position", "x"))
    each = normalized(v.filter("reason IS NOT NULL OR position IS NOT NULL").select("batch", "idx", "reason", "text", "position", "x.*"), index)
    quote = F.when(tx.strip(F.col("evidence")) != "", F.col("evidence"))
    held = F.contains("text", F.col("quote"))
    each = each.withColumn("quote", quote).withColumn("evidence", F.when(held, F.col("quote"))).withColumn("gone", F.when(~held, F.col("quote")))
    per = each.groupBy("batch", "idx", "reason", "aspect").agg(*_fold(), F.collect_list("gone").alias("gone"))
    none = F.lit(None).cast("string")
    row = lambda kind, slot, sentiment, evidence: F.struct(kind.alias("kind"), slot.alias("slot"), sentiment.alias("sentiment"), evidence.alias("evidence"))
    own = row(F.when(F.col("reason").isNull(), "mentions").otherwise("failures"), F.col("slot"), F.when(F.col("reason").isNull(), F.col("sentiment")), F.col("evidence"))
    rows = F.concat(F.array(own), F.transform("gone", lambda g: row(F.lit("repairs"), none, none, g)))
    return per.select("batch", "idx", "reason", "aspect", F.inline(rows)).select("batch", "idx", "kind", "aspect", "slot", "sentiment", "evidence", "reason")


def parsed(replies: DataFrame, texts: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """replies (batch, size, reply) and the texts asked about (batch, idx, text) -> mentions, failures, repairs.

    mentions: batch, idx, aspect, slot, sentiment, evidence, one row for each aspect of a text; failures: batch, idx, reason;
    repairs: batch, idx, aspect, evidence that was not in the text and so went. A text fails as a whole with any bad item;
    evidence that is blank is none, without a repair. Who needs several of them takes ``found``, which reads the replies once.
    """
    both = found(replies, texts, index)
    reasons = F.explode(F.when(F.col("reason").isNotNull(), F.array("reason"))).alias("reason")  # a filter would work out each reason twice
    failures = verdicts(replies).select("batch", "idx", reasons).distinct()
    repairs = both.filter("kind = 'repairs'").select("batch", "idx", "aspect", "evidence")
    return both.filter("kind = 'mentions'").select("batch", "idx", "aspect", "slot", "sentiment", "evidence"), failures, repairs


def folded(mentions: DataFrame) -> DataFrame:
    """One row for each aspect of a text: sentiments that differ make mixed, the first evidence stays, and the first slot."""
    return mentions.groupBy("batch", "idx", "aspect").agg(*_fold())


def _fold() -> list[Column]:
    one = F.min("sentiment") == F.max("sentiment")
    return [
        F.min_by("slot", "position").alias("slot"), F.when(one, F.min("sentiment")).otherwise("mixed").alias("sentiment"),
        F.min(F.when(F.col("evidence").isNotNull(), F.struct("position", "evidence")))["evidence"].alias("evidence"),
    ]


def usage(bodies: DataFrame) -> DataFrame:
    """Token counts of provider bodies (body: JSON), whichever of two spellings they use: prompt, cached, output, thinking.

    One provider counts reasoning within its completion tokens, the other apart; cached tokens never pass the prompt's.
    """
    number = lambda path: F.expr(f"try_variant_get(b, '{path}', 'bigint')")
    rows = bodies.withColumn("b", F.expr("try_parse_json(body)"))
    apart = number("$.usageMetadata.promptTokenCount").isNotNull()
    prompt = F.coalesce(number("$.usageMetadata.promptTokenCount"), number("$.usage.prompt_tokens"))
    cached = F.coalesce(number("$.usageMetadata.cachedContentTokenCount"), number("$.usage.prompt_tokens_details.cached_tokens"), number("$.usage.prompt_cache_hit_tokens"), F.lit(0).cast("long"))
    thinking = F.coalesce(F.when(apart, number("$.usageMetadata.thoughtsTokenCount")).otherwise(number("$.usage.completion_tokens_details.reasoning_tokens")), F.lit(0).cast("long"))
    output = F.when(apart, F.coalesce(number("$.usageMetadata.candidatesTokenCount"), F.lit(0).cast("long"))).otherwise(number("$.usage.completion_tokens") - thinking)
    return rows.select(*bodies.columns, prompt.alias("prompt"), F.least(cached, prompt).alias("cached"), output.alias("output"), thinking.alias("thinking"))


def next_attempts(outcomes: DataFrame) -> DataFrame:
    """outcomes (batch, idx, attempt, ok) -> what is tried again: failures of the initial pass in a new batch, failures of that
    alone, and then no more. One row for each (batch, idx) that is still owed, with its next attempt."""
    last = outcomes.groupBy("batch", "idx").agg(F.max_by("ok", "attempt").alias("ok"), F.max("attempt").alias("attempt"))
    step = F.when(F.col("attempt") == 0, "rebatch").when(F.col("attempt") == 1, "isolate")
    return last.filter(~F.col("ok")).select("batch", "idx", step.alias("next")).filter("next IS NOT NULL")


def first_value_drift(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Keys whose value is not what it was first: key, pinned, drifted (the first other value)."""
    at = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pinned = rows.withColumn("pinned", F.first(value).over(at)).filter(~F.col(value).eqNullSafe(F.col("pinned")))
    return pinned.groupBy(key).agg(F.first("pinned").alias("pinned"), F.min_by(value, order).alias("drifted"))
