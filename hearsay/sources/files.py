"""Vocabularies, samples and label sheets in files, each checked as a whole: problems are rows, and a reader that finds any
raises with all of them."""

from __future__ import annotations

import hashlib
import tomllib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearsay.functions import text as tx

SENTIMENTS = ("positive", "negative", "mixed", "neutral")


def review_files(spark: SparkSession, folder: str, without: tuple[str, ...] = ()) -> list[str]:
    """The <app_id>_reviews.jsonl files of a folder by name, without those of some apps. None is an error."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*_reviews.jsonl").load(folder).select("path")
    app = F.regexp_extract("path", r"(\d+)_[^/]*$", 1)
    paths = [r[0] for r in found.filter(~app.isin(*sorted(without)) if without else F.lit(True)).orderBy("path").collect()]  # a path an app
    if not paths:
        raise ValueError(f"no review files in {folder}")
    return paths


def content_stamp(spark: SparkSession, path: str) -> tuple[str, str]:
    """A vocabulary file's version and the sha256 of its bytes."""
    raw = bytes(spark.read.format("binaryFile").load(path).first()["content"])  # one small file
    version = tomllib.loads(raw.decode("utf-8")).get("version")
    if not isinstance(version, str) or not version.strip():
        raise ValueError("the vocabulary has no version")
    return version, hashlib.sha256(raw).hexdigest()


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """A TOML vocabulary: place, label, category, definition, label_when, do_not_label_when, aliases, examples."""
    raw = bytes(spark.read.format("binaryFile").load(path).first()["content"])
    doc = tomllib.loads(raw.decode("utf-8"))
    texts, lists = ("label", "category", "definition", "label_when", "do_not_label_when"), ("aliases", "examples")
    rows = [(i, *(a.get(k) for k in texts), *(a.get(k) or [] for k in lists)) for i, a in enumerate(doc.get("aspects", []))]
    kinds = "place int, " + ", ".join(f"{k} string" for k in texts) + ", " + ", ".join(f"{k} array<string>" for k in lists)
    out = spark.createDataFrame(rows, kinds)
    problems = [r["problem"] for r in vocabulary_problems(out, doc.get("categories", [])).orderBy("problem").collect()]  # of one small file
    if problems:
        raise ValueError("the vocabulary is not in order:\n" + "\n".join(problems))
    return out


def vocabulary_problems(entries: DataFrame, categories: list[str]) -> DataFrame:
    """One row, problem, for each fault of a vocabulary."""
    say = lambda d, *parts: d.select(F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts)).alias("problem"))
    label = F.col("label")
    out = say(entries.groupBy("label").count().filter("count > 1"), "label twice: ", label)
    out = out.union(say(entries.filter(~F.coalesce(tx.is_snake_case(label), F.lit(False))), "not snake case: ", F.coalesce(label, F.lit("?"))))
    out = out.union(say(entries.filter(~F.col("category").isin(*categories) if categories else F.lit(True)), "category not declared: ", label, " ", F.col("category")))
    empty = F.lit(False)
    for c in ("definition", "category", "label_when", "do_not_label_when"):
        empty = empty | (F.trim(F.coalesce(c, F.lit(""))) == "")
    out = out.union(say(entries.filter(empty | (F.size("aliases") == 0) | (F.size("examples") == 0)), "a field is empty: ", label))
    surfaces = entries.select("label", F.explode("aliases").alias("alias")).withColumn("key", tx.match_key("alias"))
    out = out.union(say(surfaces.groupBy("key").agg(F.count_distinct("label").alias("n")).filter("n > 1"), "an alias of several labels: ", F.col("key")))
    keys = entries.select(F.col("label").alias("other"), tx.match_key("label").alias("key"))
    out = out.union(say(surfaces.join(keys, "key").filter("label <> other"), "an alias is another label: ", F.col("alias")))
    named = entries.select("label", F.explode(F.concat(F.array("definition", "label_when", "do_not_label_when"), "examples")).alias("t"))
    named = named.select("label", F.explode(tx.backtick_names(F.col("t"))).alias("name")).join(entries.select(F.col("label").alias("name")), "name", "left_anti")
    return out.union(say(named, "names no label: ", F.col("name"), " in ", label))


def checked(rows: DataFrame, key: str, allowed: dict[str, tuple[str, ...]] | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """One row (key, problem) for each fault of records: a key twice or missing, a required field that is empty, a value that is
    not allowed."""
    faults = [F.when(F.col(key).isNull(), "no key")]
    faults += [F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", f"{c} is empty") for c in required]
    faults += [F.when(~F.coalesce(F.col(c).isin(*vs), F.lit(False)), f"{c} is not allowed") for c, vs in (allowed or {}).items()]
    each = rows.select(F.col(key).cast("string").alias("key"), F.explode(F.array_compact(F.array(*faults))).alias("problem"))
    twice = rows.groupBy(F.col(key).cast("string").alias("key")).count().filter("count > 1").select("key", F.lit("key twice").alias("problem"))
    return each.unionByName(twice)


def read_records(spark: SparkSession, path: str, schema: str, key: str, allowed: dict[str, tuple[str, ...]] | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """JSON Lines of a schema, refused as a whole if a line is broken or a record is not in order."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    first = checked(rows, key, allowed, required).orderBy("key", "problem").limit(20).collect()
    if first:
        raise ValueError("; ".join(f"{r['key']}: {r['problem']}" for r in first))
    return rows


def manifest_windows(spark: SparkSession, path: str) -> DataFrame:
    """app_id, start, end of a fetch manifest, each game of which must have exactly one window."""
    shape = "games array<struct<app_id:bigint,name:string,role:string,windows:array<struct<start:string,end:string>>>>"
    games = spark.read.schema(shape).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.inline("games"))
    one = F.when(F.size("windows") == 1, F.get("windows", 0)).otherwise(F.raise_error(F.concat(F.lit("not one window: "), F.col("app_id").cast("string"))).cast("struct<start:string,end:string>"))
    return games.withColumn("w", one).select("app_id", F.to_timestamp("w.start").alias("start"), F.to_timestamp("w.end").alias("end"))


#: The lines of a label sheet, as patterns.
HEAD_LINE, BOX_LINE, OPEN_LINE, SKIP_LINE = r"^## \d+ · review (\S+)$", r"^- \[( |x)\] reviewed$", "^(`{3,})text$", r"^SKIP: (non_english|empty_text)\.?$"
ZERO_LINE, NO_SPAN = "Zero mentions.", "(no span)"


RUNS = T.StructType([T.StructField("first", T.ArrayType(T.IntegerType())), T.StructField("last", T.ArrayType(T.IntegerType())), T.StructField("review_id", T.ArrayType(T.StringType())), T.StructField("left_open", T.BooleanType()), T.StructField("open_in", T.StringType())])


def _plain_runs(lines, opens, texts, heads, n: int) -> tuple:
    """The runs of lines outside of fences that belong to a review: first lines, last lines, reviews; is the last fence open, and in which
    review. A fence ends at the next line of just its own backticks. Only lines that can open or end a fence, and headings, are given."""
    first, last, reviews, review, run, since = [], [], [], None, "", 1

    def end(at: int) -> None:
        if review is not None and since <= at:
            first.append(since)
            last.append(at)
            reviews.append(review)

    for line, opened, text, head in zip(lines, opens, texts, heads, strict=True):
        if run:
            if text == run:
                run, since = "", line + 1
        elif head:
            end(line - 1)
            review, since = head, line
        elif opened:
            end(line - 1)
            run = opened
    if not run:
        end(n)
    return first, last, reviews, bool(run), review if run else None


@F.pandas_udf(RUNS)
def plain_runs(lines: pd.Series, opens: pd.Series, texts: pd.Series, heads: pd.Series, n: pd.Series) -> pd.DataFrame:
    """``_plain_runs`` of each file, in one pass over what can open or end a run."""
    found = [((), (), (), False, None) if a is None else _plain_runs(a.tolist(), b, c, d, k) for a, b, c, d, k in zip(lines, opens, texts, heads, n, strict=True)]
    return pd.DataFrame(found, columns=RUNS.names)


SHEET = "file string, review_id string, what string, aspect string, sentiment string, evidence string, line int"


def sheets(files: DataFrame) -> DataFrame:
    """files (file, text: whole sheets) -> rows of SHEET, one for each line that says something.

    what: review, checked (its box is ticked), mention, zero, skip (aspect: why) or problem (aspect: the line). A mention is
    ``- aspect / sentiment / "evidence"``, or (no span) in place of the evidence, in which \\n and \\r stand for line ends; with fewer
    than three parts, or evidence without two marks, it is a malformed mention line. What stands in a fence is the review's own
    text and says nothing; notes (>), rules and what comes before the first review say nothing either.
    """
    whole = files.filter("text IS NOT NULL").select("file", F.transform(F.split("text", r"\r\n|\n|\r", -1), tx.strip).alias("lines"))
    can = F.transform("lines", lambda x, i: F.struct((i + 1).alias("line"), F.regexp_extract(x, OPEN_LINE, 1).alias("opens"), x.alias("text"), F.regexp_extract(x, HEAD_LINE, 1).alias("head")))
    marked = whole.select("file", "lines", F.filter(can, lambda m: m["text"].startswith("```") | (m["head"] != "")).alias("m"))
    cut = marked.select("file", "lines", plain_runs("m.line", "m.opens", "m.text", "m.head", F.size("lines")).alias("runs"))
    runs = F.arrays_zip("runs.first", "runs.last", "runs.review_id")
    of = lambda x: F.transform(F.slice("lines", x["first"], x["last"] - x["first"] + 1), lambda t, i: F.struct((x["first"] + i).cast("int").alias("line"), x["review_id"].alias("review_id"), t.alias("t")))
    open_ = F.when(F.col("runs.left_open"), F.array(F.struct(F.size("lines").alias("line"), F.col("runs.open_in").alias("review_id"), F.lit(None).cast("string").alias("t"))))
    said = cut.select("file", F.inline(F.concat(F.flatten(F.transform(runs, of)), F.coalesce(open_, F.array().cast("array<struct<line:int,review_id:string,t:string>>")))))
    t = F.col("t")
    parts = F.split(F.substring(t, 3, 10**6), " / ", 3)
    shown = tx.strip(F.get(parts, 2))
    quoted = F.regexp_extract(shown, '(?s)"(.*)"', 1)
    readable = (F.size(parts) == 3) & ((shown == NO_SPAN) | shown.rlike('(?s)".*"'))
    evidence = F.when(shown != NO_SPAN, F.replace(F.replace(quoted, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    what = (
        F.when(t.rlike(HEAD_LINE), "review").when(t.rlike(BOX_LINE), F.when(t == "- [x] reviewed", "checked").otherwise("open")).when(t == ZERO_LINE, "zero").when(t.rlike(SKIP_LINE), "skip")
        .when(t.startswith("- "), F.when(readable, "mention").otherwise("problem")).otherwise("problem")
    )
    said = said.filter(t.isNull() | ((t != "") & ~t.startswith(">") & (t != "---"))).withColumn("what", what).filter("what <> 'open'")
    mention = F.col("what") == "mention"
    problem = F.when(t.isNull(), "the last fence is open").when(t.startswith("- "), F.concat(F.lit("malformed mention line: "), t)).otherwise(t)
    aspect = F.when(mention, tx.strip(F.get(parts, 0))).when(F.col("what") == "skip", F.regexp_extract(t, SKIP_LINE, 1)).when(F.col("what") == "problem", problem)
    return said.select("file", "review_id", "what", aspect.alias("aspect"), F.when(mention, tx.strip(F.get(parts, 1))).alias("sentiment"), F.when(mention, evidence).alias("evidence"), "line")


def unchecked(rows: DataFrame) -> DataFrame:
    """file, review_id: reviews of sheets whose box is not ticked."""
    per = rows.groupBy("file", "review_id").agg(F.count_if(F.col("what") == "review").alias("n"), F.count_if(F.col("what") == "checked").alias("c"))
    return per.filter("n > 0 AND c = 0").select("file", "review_id")


def sheet_reference(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What sheets say of each review: mentions (review_id, aspect, sentiment, evidence), and skips (review_id, why)."""
    return rows.filter("what = 'mention'").select("review_id", "aspect", "sentiment", "evidence"), rows.filter("what = 'skip'").select("review_id", F.col("aspect").alias("why"))


def sheet_problems(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """review_id, problem: reviews that are unknown, not exactly one of mentions, zero and skip, sentiments that are none, and
    evidence that is not in the review's text (review_id, text)."""
    per = rows.groupBy("review_id").agg(*[F.count_if(F.col("what") == w).alias(w) for w in ("mention", "zero", "skip")])
    states = (F.col("mention") > 0).cast("int") + (F.col("zero") > 0).cast("int") + (F.col("skip") > 0).cast("int")
    known = per.join(texts.select("review_id", F.lit(True).alias("here")), "review_id", "left")
    out = known.filter("here IS NULL AND review_id IS NOT NULL").select("review_id", F.lit("unknown review").alias("problem"))
    out = out.unionByName(unchecked(rows).select("review_id", F.lit("not reviewed").alias("problem")))
    twice = rows.filter("what = 'mention'").groupBy("review_id", "aspect").agg(F.count("*").alias("n")).filter("n > 1")
    out = out.unionByName(twice.select("review_id", F.concat(F.lit("an aspect twice: "), "aspect").alias("problem")))
    out = out.unionByName(known.filter(F.col("here").isNotNull() & (states != 1)).select("review_id", F.lit("needs one of mentions, zero, skip").alias("problem")))
    m = rows.filter("what = 'mention'").join(texts.select("review_id", "text"), "review_id")
    out = out.unionByName(m.filter(~F.col("sentiment").isin(*SENTIMENTS)).select("review_id", F.lit("no such sentiment").alias("problem")))
    out = out.unionByName(m.filter(F.col("evidence").isNotNull() & ~F.contains("text", F.col("evidence"))).select("review_id", F.lit("evidence is not in the text").alias("problem")))
    return out.unionByName(rows.filter("what = 'problem'").select("review_id", F.concat(F.lit("cannot be read: "), "aspect").alias("problem")))
