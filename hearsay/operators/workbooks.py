"""Labelling workbooks: what an assistant proposed is verified, people's sheets are compared with it, and gold is minted from
them; audit sheets are read claim by claim. Problems are rows; nothing is minted while there are any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.functions import text as tx
from hearsay.sources import files

#: Flags that an assistant may set on a review.
FLAGS = ("non_english",)
#: Pinned aspects that tell of the player's disposition.
DISPOSITIONS = ("addictiveness", "relaxation", "emotional_impact", "difficulty", "learning_curve")
#: The lines of an audit sheet, as patterns, and the words of a verdict.
CLAIM_LINE, ID_LINE, FIELD_LINE = r"^## (\d+) ·", r"^review `(\S+)` · mention `(\d+)`$", r"^- (aspect_supported|sentiment_supported|note):\s*(.*)$"
VERDICTS = ("yes", "no", "unclear")


def _get(v: str, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _is_text(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def annotations(outputs: DataFrame) -> DataFrame:
    """outputs (batch, payload: JSON) -> batch, says (its own batch number), place, review_id, mentions, flags, note; one row for
    each annotation, and one with a null place for a payload without any; broken: not JSON."""
    # a parser stops at the end of a value: what follows it is seen only within brackets of both kinds
    within = lambda a, z: F.concat(F.lit(a), "payload", F.lit(z))
    whole = (F.json_array_length(within("[", "]")) == 1) & F.try_parse_json(within('{"x":', "}")).isNotNull()
    read = outputs.select("batch", F.when(whole, F.try_parse_json("payload")).alias("v"))
    read = read.select("batch", F.col("v").isNull().alias("broken"), _get("v", "$.batch", "bigint").alias("says"), F.posexplode_outer(_get("v", "$.annotations", "array<variant>")).alias("place", "a"))
    return read.select(
        "batch", "broken", "says", F.col("place").cast("long").alias("place"), _get("a", "$.id", "string").alias("review_id"), _get("a", "$.mentions", "array<variant>").alias("mentions"),
        _get("a", "$.flags", "array<variant>").alias("flags"), _get("a", "$.note", "variant").alias("note"),
    )


def assist_mentions(outputs: DataFrame) -> DataFrame:
    """review_id, place, aspect, sentiment, evidence of what an assistant proposed."""
    m = annotations(outputs).select("review_id", F.posexplode("mentions").alias("place", "m"))
    return m.select("review_id", F.col("place").cast("long").alias("place"), *[_get("m", f"$.{c}", "string").alias(c) for c in ("aspect", "sentiment", "evidence")])


def assist_problems(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """batch, review_id, problem. inputs: batch, place, review_id, text; outputs: batch, payload.

    Every batch is answered once, under its own number, with its reviews in their order; sentiments are known, aspects are
    words, evidence stands in the review's text, flags are known and notes are texts. Order counts only where the reviews agree.
    """
    said = annotations(outputs)
    text = lambda c: f"try_variant_get(m, '$.{c}', 'string')"
    worded = "coalesce(schema_of_variant(try_variant_get(m, '$.aspect', 'variant')) = 'STRING', false)"
    parts = F.expr(f"transform(mentions, m -> struct({text('sentiment')} AS sentiment, {text('evidence')} AS evidence, {worded} AND trim(coalesce({text('aspect')}, '')) <> '' AS aspect_ok))")
    note = F.col("note").isNotNull() & ~F.is_variant_null("note") & ~_is_text(F.col("note"))
    said = said.select(
        "batch", "broken", "says", "place", "review_id", parts.alias("parts"), F.expr("transform(flags, f -> try_variant_get(f, '$', 'string'))").alias("flags"), F.coalesce(note, F.lit(False)).alias("odd_note"),
        F.lit(None).cast("long").alias("wanted"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("asked"),
    )
    asked = inputs.select("batch", "review_id", F.col("place").cast("long").alias("wanted"), "text", F.lit(True).alias("asked"))
    # inputs and outputs meet once, by batch: a review's rows stand together, and a batch's
    rows = said.unionByName(asked, allowMissingColumns=True).repartition("batch")
    one, all_ = Window.partitionBy("batch", "review_id"), Window.partitionBy("batch")
    rows = rows.withColumns({
        "times": F.count("place").over(one), "at": F.min("place").over(one), "due": F.count_if("asked").over(one), "should": F.max("wanted").over(one),
        "source": F.coalesce(F.max("text").over(one), F.lit("")), "k": F.row_number().over(one.orderBy("asked", F.col("place").asc_nulls_last())),
    })
    came = ~F.col("asked") & F.col("place").isNotNull()
    # a review that is missing is told by its input, one that came by the first of its annotations
    wrong = F.when(F.col("asked") & (F.col("times") == 0), "missing").when(came & (F.col("k") == 1), F.when(F.col("due") == 0, "unexpected").when(F.col("times") > 1, "comes twice"))
    rows = rows.withColumn("wrong", wrong)
    rows = rows.withColumns({
        "read": F.coalesce(F.bool_or(~F.col("asked") & ~F.col("broken")).over(all_), F.lit(False)), "answered": F.bool_or(~F.col("asked")).over(all_), "n": F.count("wrong").over(all_),
        "differs": F.coalesce(F.bool_or(~F.col("asked") & ~F.col("broken") & ~F.coalesce(F.col("says") == F.col("batch"), F.lit(False))).over(all_), F.lit(False)),
        "moved": F.coalesce(F.bool_or(came & (F.col("should") != F.col("at"))).over(all_), F.lit(False)), "first": F.row_number().over(all_.orderBy("review_id", "k")) == 1,
    })
    whole = ~F.col("asked") & ~F.col("broken")
    bad_sentiment = lambda x: F.when(~F.coalesce(x["sentiment"].isin(*files.SENTIMENTS), F.lit(False)), "bad sentiment")
    unseen = lambda x: F.when(x["evidence"].isNotNull() & ~F.contains(F.col("source"), x["evidence"]), "evidence is not in the text")
    faults = F.flatten(F.transform("parts", lambda x: F.array(bad_sentiment(x), unseen(x), F.when(~x["aspect_ok"], "bad aspect"))))
    unknown = F.transform("flags", lambda f: F.when(~F.coalesce(f.isin(*FLAGS), F.lit(False)), "unknown flag"))
    none = F.array().cast("array<string>")
    own = F.concat(F.array(F.when(F.col("read"), F.col("wrong")), F.when(whole & F.col("odd_note"), "note is no text")), F.when(whole, F.coalesce(unknown, none)).otherwise(none), F.when(whole, F.coalesce(faults, none)).otherwise(none))
    of_batch = F.array(
        F.when(~F.col("asked") & F.col("broken"), "unreadable output"), F.when(F.col("first") & ~F.col("answered"), "no output"), F.when(F.col("first") & F.col("differs"), "batch field differs"),
        F.when(F.col("first") & F.col("read") & (F.col("n") == 0) & F.col("moved"), "out of order"),
    )
    said_of = lambda problems, review: F.transform(F.array_compact(problems), lambda p: F.struct(review.alias("review_id"), p.alias("problem")))
    return rows.select("batch", F.inline(F.concat(said_of(of_batch, F.lit(None).cast("string")), said_of(own, F.col("review_id")))))


def assist_totals(outputs: DataFrame, pinned: DataFrame) -> DataFrame:
    """Per batch: reviews, mentions, zero (reviews without a mention), candidates (mentions of aspects that aren't pinned), flags, notes."""
    a = annotations(outputs).filter("place IS NOT NULL")
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    sums = a.groupBy("batch").agg(
        F.count("*").alias("reviews"), F.sum(F.when(F.col("mentions").isNull(), 0).otherwise(n("mentions"))).cast("long").alias("mentions"),
        F.count_if(F.col("mentions").isNull() | (n("mentions") == 0)).alias("zero"), F.sum(F.when(F.col("flags").isNull(), 0).otherwise(n("flags"))).cast("long").alias("flags"),
        F.count_if(_is_text(F.col("note")) & (F.try_variant_get("note", "$", "string") != "")).alias("notes"),
    )
    m = a.select("batch", F.explode("mentions").alias("m")).select("batch", _get("m", "$.aspect", "string").alias("aspect"))
    free = m.join(pinned.select("aspect").distinct(), "aspect", "left_anti").groupBy("batch").agg(F.count("aspect").alias("candidates"))
    return sums.join(free, "batch", "left").fillna(0, ["candidates"])


def assist_diff(current: DataFrame, proposed: DataFrame) -> DataFrame:
    """review_id, aspect, outcome (accepted, modified, added, deleted), was, now (sentiments): how people changed what was proposed.

    current, proposed: review_id, place, aspect, sentiment, evidence. Equal mentions are accepted, as often as both have them; what is
    left of one aspect in both is modified, in the order of places; the rest is added or deleted. One shuffle by mention, one by aspect.
    """
    side = lambda d, s: d.select(F.lit(s).alias("side"), "review_id", "aspect", "sentiment", "evidence", "place")
    rows = side(current, 1).unionByName(side(proposed, 0))
    same = Window.partitionBy("review_id", "aspect", "sentiment", "evidence")
    rows = rows.withColumn("k", F.row_number().over(same.orderBy("side", "place")))
    ours, theirs = F.count_if(F.col("side") == 1).over(same), F.count_if(F.col("side") == 0).over(same)
    turn = F.when(F.col("side") == 1, F.col("k") - F.col("theirs")).otherwise(F.col("k"))  # proposals are numbered first
    rows = rows.withColumn("ours", ours).withColumn("theirs", theirs).withColumn("accepted", turn <= F.least("ours", "theirs"))
    kept = rows.filter("accepted AND side = 1").select("review_id", "aspect", F.lit("accepted").alias("outcome"), F.col("sentiment").alias("was"), F.col("sentiment").alias("now"))
    left = rows.filter("NOT accepted").withColumn("n", F.row_number().over(Window.partitionBy("side", "review_id", "aspect").orderBy("place", "sentiment")))
    pairs = left.groupBy("review_id", "aspect", "n").agg(
        F.count_if(F.col("side") == 1).alias("a"), F.count_if(F.col("side") == 0).alias("b"), F.max(F.when(F.col("side") == 0, F.col("sentiment"))).alias("was"), F.max(F.when(F.col("side") == 1, F.col("sentiment"))).alias("now")
    )
    outcome = F.when(F.col("a") == 0, "deleted").when(F.col("b") == 0, "added").otherwise("modified")
    return kept.unionByName(pairs.select("review_id", "aspect", outcome.alias("outcome"), "was", "now"))


def mint_faults(rows: DataFrame, replacements: DataFrame) -> DataFrame:
    """review_id, problem: why no gold can be minted. rows: sheets as read; replacements: review_id (skipped), replacement_id."""
    out = files.unchecked(rows).select("review_id", F.lit("not reviewed").alias("problem"))
    per = rows.groupBy(F.col("review_id").alias("replacement_id")).agg(F.max((F.col("what") == "checked").cast("int")).alias("checked"), F.max((F.col("what") == "skip").cast("int")).alias("skipped"))
    r = replacements.join(per, "replacement_id", "left")
    why = F.when(F.col("checked").isNull(), "replacement is missing").when(F.col("checked") == 0, "replacement is not reviewed").when(F.col("skipped") == 1, "replacement is skipped")
    return out.unionByName(r.select("review_id", why.alias("problem")).filter("problem IS NOT NULL"))


def gold_records(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """review_id, app_id, text, mentions (in the sheet's order) of every review of the sheets that isn't skipped. texts: review_id, app_id, text."""
    one = F.struct("line", "aspect", "sentiment", "evidence")
    per = rows.groupBy("review_id").agg(F.max((F.col("what") == "skip").cast("int")).alias("skip"), F.array_sort(F.collect_list(F.when(F.col("what") == "mention", one))).alias("m"))
    mentions = F.transform("m", lambda x: F.struct(x["aspect"].alias("aspect"), x["sentiment"].alias("sentiment"), x["evidence"].alias("evidence")))
    return per.filter("skip = 0").join(texts.select("review_id", "app_id", "text"), "review_id").select("review_id", "app_id", "text", mentions.alias("mentions"))


def gold_summary(records: DataFrame, pinned: DataFrame, *keys: str) -> DataFrame:
    """Records, mentions, zero, zero_share, a count for each sentiment and candidate labels of minted gold."""
    m = records.select(*keys, F.explode("mentions").alias("m")).select(*keys, "m.aspect", "m.sentiment").groupBy(*keys, "aspect", "sentiment").agg(F.count("*").alias("n"))
    free = m.join(pinned.select("aspect", F.lit(True).alias("pin")).distinct(), "aspect", "left")
    feel = free.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("sentiment") == s, F.col("n"))), F.lit(0)).alias(s) for s in files.SENTIMENTS], F.count_distinct(F.when(F.col("pin").isNull(), F.col("aspect"))).alias("candidates"))
    sums = records.groupBy(*keys).agg(F.count("*").alias("records"), F.sum(F.size("mentions")).cast("long").alias("mentions"), F.count_if(F.size("mentions") == 0).alias("zero"))
    sums = sums.withColumn("zero_share", F.round(F.col("zero") / F.col("records"), 3))
    return (sums.join(feel, list(keys), "left") if keys else sums.join(feel, F.lit(True), "left")).fillna(0)


def flip_contrast(diff: DataFrame, records: DataFrame, dispositions: tuple[str, ...] = DISPOSITIONS) -> DataFrame:
    """disposition (or not): mentions of gold, and sentiments that people turned."""
    of = F.col("aspect").isin(*dispositions).alias("disposition")
    flips = diff.filter("outcome = 'modified' AND was <> now").groupBy(of).agg(F.count("*").alias("flips"))
    m = records.select(F.explode("mentions").alias("m")).select(F.col("m.aspect").alias("aspect")).groupBy(of).agg(F.count("*").alias("mentions"))
    return m.join(flips, "disposition", "full_outer").fillna(0, ["mentions", "flips"])


def audit_sheets(sheets: DataFrame) -> DataFrame:
    """sheets (file, text) -> file, line, item, what, review_id, mention_id, aspect_supported, sentiment_supported, note, says.

    A claim starts with its heading and goes to the next. what: claim (both verdicts are words of VERDICTS), skip (says: why) or
    problem (says: what). The last line of a kind counts. Lines before the first claim, quotations, rules and blanks say nothing.
    Numbers of lines are those of a claim's heading, or of the line that cannot be read.
    """
    lines = sheets.select("file", F.posexplode(F.split("text", r"\r\n|\n|\r", -1)).alias("at", "raw")).select("file", (F.col("at") + 1).alias("line"), tx.strip(F.col("raw")).alias("t"))
    t = F.col("t")
    head = t.rlike(CLAIM_LINE)
    lines = lines.withColumn("block", F.count_if(head).over(Window.partitionBy("file").orderBy("line"))).filter("block > 0")
    kind = F.when(head, "head").when((t == "") | t.startswith(">") | (t == "---"), "quiet").when(t.rlike(ID_LINE), "id").when(t.rlike(files.SKIP_LINE), "skip").when(t.rlike(FIELD_LINE), F.regexp_extract(t, FIELD_LINE, 1)).otherwise("other")
    lines = lines.withColumn("kind", kind).filter("kind <> 'quiet'").withColumn("value", tx.strip(F.regexp_extract("t", FIELD_LINE, 2)))
    last = lambda k, c: F.max_by(c, F.when(F.col("kind") == k, F.col("line")))
    per = lines.groupBy("file", "block").agg(
        F.min("line").alias("line"), last("head", F.regexp_extract("t", CLAIM_LINE, 1)).cast("int").alias("item"), last("id", F.regexp_extract("t", ID_LINE, 1)).alias("review_id"), last("id", F.regexp_extract("t", ID_LINE, 2)).alias("mention_id"),
        last("skip", F.regexp_extract("t", files.SKIP_LINE, 1)).alias("why"), *[last(f, F.lower("value")).alias(f) for f in ("aspect_supported", "sentiment_supported")], last("note", F.col("value")).alias("note"),
    )
    filled = lambda f: F.coalesce(F.col(f), F.lit("")) != ""
    judged = filled("aspect_supported") | filled("sentiment_supported")
    bad = lambda f: F.when(~filled(f), F.lit(f"unfilled verdict {f}")).when(~F.col(f).isin(*VERDICTS), F.concat(F.lit(f"bad verdict {f}: "), f))
    faults = (
        F.when(F.col("why").isNotNull(), F.array(F.when(judged, F.lit("skipped but carries verdicts")))).when(F.col("review_id").isNull(), F.array(F.lit("no id line")))
        .otherwise(F.array(bad("aspect_supported"), bad("sentiment_supported")))
    )
    per = per.withColumn("faults", F.array_compact(faults))
    right = F.size("faults") == 0
    good = F.when(right & F.col("why").isNotNull(), F.struct(F.lit("skip").alias("what"), F.col("why").alias("says"))).when(right, F.struct(F.lit("claim").alias("what"), F.lit(None).cast("string").alias("says")))
    found = F.array_compact(F.concat(F.array(good), F.transform("faults", lambda x: F.struct(F.lit("problem").alias("what"), x.alias("says")))))
    claim = lambda c: F.when(F.col("what") == "claim", F.col(c)).alias(c)
    out = per.select("*", F.inline(found)).select("file", "line", "item", "what", claim("review_id"), claim("mention_id"), claim("aspect_supported"), claim("sentiment_supported"), F.when(F.col("what") == "claim", F.nullif(F.col("note"), F.lit(""))).alias("note"), "says")
    other = lines.filter("kind = 'other'").select("file", "line", F.concat(F.lit("unparseable line: "), "t").alias("says"), F.lit("problem").alias("what"))
    return out.unionByName(other, allowMissingColumns=True)
