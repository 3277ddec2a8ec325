"""Is every number and quotation of a piece of prose backed by computed results, and what labels a reply holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearsay.functions import text as tx
from hearsay.functions.search import parts_of


def whitelist(aggregates: DataFrame) -> DataFrame:
    """app_id, value: all that prose about an app may state. Of each pinned aspect its reviews, their share of the sample in
    percent, each sentiment's count and its percentage of both; and the sample's size. Candidates give nothing."""
    n, size = F.col("n_reviews").cast("double"), F.col("sample_size").cast("double")
    percent = lambda x, of: x / F.nullif(of, F.lit(0.0)) * 100
    counts = [F.col(f"n_{s}").cast("double") for s in ("positive", "negative", "mixed", "neutral")]
    values = [n, percent(n, size), *counts, *(percent(c, n) for c in counts), *(percent(c, size) for c in counts)]
    own = aggregates.filter("slot = 'pinned'").select("app_id", F.explode(F.array_compact(F.array(*values))).alias("value"))
    return own.unionByName(aggregates.select("app_id", size.alias("value"))).distinct()


def ungrounded_numbers(prose: DataFrame, facts: DataFrame, key: str, by: str) -> DataFrame:
    """Numerals of prose (key, by, text) that no value of facts (by, value) rounds to: key, token, n.

    Numerals inside quotations are left out. Distinct values are rounded to each number of decimals once, so a token meets
    them by an equal join.
    """
    tokens = spans_of(prose, key, by).filter("kind = 'numeral'").groupBy(key, by, "span").agg(F.count("*").alias("n"))
    places, number = tx.numeral_value(F.col("span"))
    known = tx.roundings(facts.select(F.col(by), "value").distinct(), by)
    return tokens.withColumn("places", places).withColumn("number", number).join(known, [by, "places", "number"], "left_anti").select(key, F.col("span").alias("token"), "n")


def spans_of(prose: DataFrame, key: str, by: str) -> DataFrame:
    """Quotations, numerals outside of them and unpaired marks of prose (key, by, text): key, by, start, end, span, kind."""
    return tx.prose_spans(prose.select(key, by, tx.plain_quotes(F.col("text")).alias("text")), key, by)


def grounded(prose: DataFrame, facts: DataFrame, evidence: DataFrame, key: str, by: str) -> DataFrame:
    """Every numeral and quotation of prose (key, by, text): key, start, end, span, kind, value, review_id, reason.

    Certified spans have no reason: numerals the least value of facts (by, value) that rounds to them at their own decimals,
    quotations the least review_id of evidence (by, review_id, text) whose text has their words. The rest are violations.
    """
    places, number = tx.numeral_value(F.col("span"))
    words = tx.quoted_words(F.substring("span", F.lit(2), F.length("span") - 2))
    numeral, quote = F.col("kind") == "numeral", F.col("kind") == "quote"
    spans = spans_of(prose, key, by).select("*", F.when(numeral, places).alias("places"), F.when(numeral, number).alias("number"), F.when(quote, words).alias("words"))
    known = tx.roundings(facts.select(by, "value").distinct(), by)
    # a pool's texts are reduced to distinct ones, and read once for the words of all quotations
    pool = evidence.groupBy(F.col(by), F.col("text").alias("source")).agg(F.min("review_id").alias("review_id"))
    asked = spans.filter("words <> ''").select(by, "words").distinct()
    found = parts_of(pool, "source", asked, "words").join(asked, [by, "words"], "left_semi").groupBy(by, "words").agg(F.min("review_id").alias("review_id"))
    reason = (
        F.when(F.col("kind") == "unpaired", "unpaired quotation mark")
        .when(numeral & F.col("value").isNull(), "matches no value at its own precision")
        .when(quote & (F.col("words") == ""), "empty quotation")
        .when(quote & F.col("review_id").isNull(), "not a part of the evidence")
    )
    rows = spans.join(known, [by, "places", "number"], "left").join(found, [by, "words"], "left")
    return rows.select(key, "start", "end", "span", F.when(numeral, "numeral").otherwise("quote").alias("kind"), "value", "review_id", reason.alias("reason"))


def cut_violations(prose: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """prose (key, text) with cut: the text without the sentences that a violation of spans touches."""
    hits = spans.filter("reason IS NOT NULL").groupBy(key).agg(F.collect_list(F.struct("start", "end")).alias("hits"))
    own = tx.sentences(prose.select(key, tx.plain_quotes(F.col("text")).alias("text")), key).drop("sentence")
    touched = F.exists("hits", lambda h: (h["start"] < F.col("end")) & (h["end"] > F.col("start")))
    kept = own.join(hits, key, "left").filter(~F.coalesce(touched, F.lit(False)))
    places = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("kept"))
    rows = prose.join(places, key, "left")
    text = F.array_join(F.transform("kept", lambda k: F.substring(F.col("text"), k["start"] + 1, k["end"] - k["start"])), "")
    return rows.withColumn("cut", F.when(F.col("text").isNotNull(), tx.strip(F.coalesce(text, F.lit(""))))).drop("kept")


def regrounding(prose: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """What to do with stored prose whose spans no longer hold, a row for each sentence that goes: key, place, sentence, reasons
    (distinct, sorted), and action: cut, or withhold where nothing would be left."""
    own = tx.sentences(prose.select(key, tx.plain_quotes(F.col("text")).alias("text")), key)
    hits = spans.filter("reason IS NOT NULL").select(key, F.col("start").alias("from"), F.col("end").alias("to"), "reason")
    bad = own.join(hits, key).filter("from < end AND to > start").groupBy(key, "place").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    judged = own.join(bad, [key, "place"], "left")
    left = judged.groupBy(key).agg(F.count_if(F.col("reasons").isNull() & (tx.strip(F.col("sentence")) != "")).alias("left"))
    rows = judged.filter("reasons IS NOT NULL").join(left, key)
    return rows.select(key, "place", tx.strip(F.col("sentence")).alias("sentence"), F.array_join("reasons", "; ").alias("reasons"), F.when(F.col("left") > 0, "cut").otherwise("withhold").alias("action"))


def segments(prose: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Prose cut along its certified spans: key, place, segment, kind (null for plain text)."""
    own = spans.filter("reason IS NULL").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("s"))
    rows = prose.join(own, key, "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<start:int,end:int,kind:string>>")))
    end = F.array(F.struct(F.length("text").alias("start"), F.length("text").alias("end"), F.lit(None).cast("string").alias("kind")))
    before = lambda i: F.when(i > 0, F.get(F.col("s"), i - 1)["end"]).otherwise(0)
    piece = lambda a, b, kind: F.struct(F.substring("text", a + 1, b - a).alias("segment"), kind.alias("kind"))
    pieces = F.flatten(F.transform(F.concat("s", end), lambda x, i: F.array(piece(before(i), x["start"], F.lit(None).cast("string")), piece(x["start"], x["end"], x["kind"]))))
    return rows.select(key, F.posexplode(F.filter(pieces, lambda p: p["segment"] != "")).alias("place", "p")).select(key, "place", "p.*")


def collapse(mentions: DataFrame) -> DataFrame:
    """One row per review and aspect: sentiments that differ make mixed, the first evidence stays, and the first slot."""
    shown = F.struct("position", "evidence")
    return mentions.groupBy("review_id", "aspect").agg(
        F.min(F.struct("position", "slot"))["slot"].alias("slot"), F.when(F.count_distinct("sentiment") == 1, F.min("sentiment")).otherwise("mixed").alias("sentiment"),
        F.min(F.when(F.col("evidence").isNotNull(), shown))["evidence"].alias("evidence"), F.count("*").alias("n"),
    )


def attributed(replies: DataFrame) -> DataFrame:
    """Rows of classifier replies (batch, size, reply: a JSON array) -> batch, idx, outcome, aspects.

    Rows that are not objects, or whose idx is no whole number (true is none), lies outside the batch or comes twice, are
    failures; ids that no row has are missing. The array is read as VARIANT, which tells numbers from booleans.
    """
    items = F.expr("try_cast(try_parse_json(reply) AS array<variant>)")
    rows = placed(replies.select("batch", "size", items.alias("items"), F.lit(None).cast("string").alias("trouble")))
    return rows.select("batch", "idx", "outcome", F.to_json("aspects").alias("aspects"))


def placed(lists: DataFrame) -> DataFrame:
    """lists (batch, size, items: array of VARIANT, trouble) -> batch, idx, outcome, aspects (VARIANT), as ``attributed``, but for lists
    with a trouble, whose ids all have that as their outcome.

    Every list brings a row for each id that was asked, so one sort by batch and id tells what is missing and what comes twice.
    """
    kind = "schema_of_variant(variant_get(x, '$.idx', 'variant'))"
    came = F.expr(f"""transform(filter(items, x -> x IS NOT NULL), x -> struct(CASE WHEN {kind} = 'BIGINT' THEN try_variant_get(x, '$.idx', 'bigint') END AS idx,
        try_variant_get(x, '$.aspects', 'variant') AS aspects, true AS came))""")
    asked = F.expr("transform(filter(sequence(0L, CAST(size AS BIGINT) - 1), i -> i >= 0), i -> struct(i AS idx, CAST(NULL AS VARIANT) AS aspects, false AS came))")
    none = F.array().cast("array<struct<idx:bigint,aspects:variant,came:boolean>>")
    rows = lists.select("batch", "size", "trouble", F.inline(F.concat(F.coalesce(came, none), F.coalesce(asked, none))))
    good = F.col("idx").isNotNull() & (F.col("idx") >= 0) & (F.col("idx") < F.col("size"))
    bad = F.when(F.col("idx").isNull(), "bad idx").when(~good, "out of range")
    same = Window.partitionBy("batch", "idx")
    rows = rows.withColumn("bad", bad).withColumns({"times": F.count_if("came").over(same), "held": F.count_if(F.col("came") & F.col("bad").isNull()).over(same)})
    own = F.coalesce("bad", F.when(F.col("times") > 1, "duplicate").otherwise("ok"))
    outcome = F.when(F.col("came"), own).otherwise(F.coalesce("trouble", F.when(F.col("held") == 0, "missing")))
    return rows.select("batch", "idx", outcome.alias("outcome"), "aspects").filter("outcome IS NOT NULL")


def checked_pins(pins: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """pins (key, pin) with outcome: matching, drifted (another sha256 now, or no text), or missing (no such key)."""
    now = texts.select(key, F.sha2("text", 256).alias("now"), F.lit(True).alias("here"))
    outcome = F.when(F.col("here").isNull(), "missing").when(F.col("now").eqNullSafe(F.col("pin")), "matching").otherwise("drifted")
    return pins.join(now, key, "left").select(*pins.columns, outcome.alias("outcome"))
