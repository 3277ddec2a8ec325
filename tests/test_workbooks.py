"""Workbooks, audits, scopes and report columns against plain loops and golden rows."""

import json
import random
from datetime import datetime

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hearsay.operators import scopes, workbooks
from hearsay.sources import columns, files


def rows_of(df, *names):
    return sorted((tuple(r[c] for c in (names or df.columns)) for r in df.collect()), key=str)


MENTION = "review_id string, place long, aspect string, sentiment string, evidence string"


def plain_diff(current, proposed):
    """Mention after mention, as lists."""
    out = []
    for review in {r[0] for r in current + proposed}:
        ours = [m[2:] for m in sorted(current, key=lambda m: m[1]) if m[0] == review]
        theirs = [m[2:] for m in sorted(proposed, key=lambda m: m[1]) if m[0] == review]
        rest = []
        for m in ours:
            if m in theirs:
                theirs.remove(m)
                out.append((review, m[0], "accepted", m[1], m[1]))
            else:
                rest.append(m)
        for m in rest:
            twin = next((x for x in theirs if x[0] == m[0]), None)
            if twin:
                theirs.remove(twin)
            out.append((review, m[0], "modified", twin[1], m[1]) if twin else (review, m[0], "added", None, m[1]))
        out += [(review, m[0], "deleted", m[1], None) for m in theirs]
    return sorted(out, key=str)


def test_diff_against_lists(spark):
    draw = random.Random(4)

    def some(n):
        seen = {}
        for _ in range(n):
            r = str(draw.randrange(12))
            seen[r] = seen.get(r, 0) + 1
            yield r, seen[r], draw.choice("ab"), draw.choice(["positive", "mixed"]), draw.choice(["x", None])

    current, proposed = list(some(60)), list(some(60))
    got = workbooks.assist_diff(spark.createDataFrame(current, MENTION), spark.createDataFrame(proposed, MENTION).repartition(3))
    assert rows_of(got) == plain_diff(current, proposed)
    none = spark.createDataFrame([], MENTION)
    assert workbooks.assist_diff(none, none).collect() == []


def test_assist_problems(spark):
    inputs = spark.createDataFrame([(b, i, f"{b}{i}", "good fun") for b in range(7) for i in range(2)] + [(7, 0, "70", None)], "batch long, place long, review_id string, text string")
    ok = lambda b, *ids: [{"id": i, "mentions": []} for i in (ids or (f"{b}0", f"{b}1"))]
    bad = [
        {"id": "50", "mentions": [{"aspect": "fun", "sentiment": "positive", "evidence": "good"}, {"aspect": " ", "sentiment": "angry"}, {"aspect": 3, "sentiment": "mixed", "evidence": "bad"}], "flags": ["non_english", "odd"], "note": 5},
        {"id": "51", "mentions": [{"aspect": "new", "sentiment": "mixed", "evidence": None}], "flags": None, "note": "why"},
    ]
    outputs = [
        (0, json.dumps({"batch": 0, "annotations": ok(0)})), (1, json.dumps({"batch": 2, "annotations": ok(1, "11", "10")})), (2, json.dumps({"batch": 2, "annotations": ok(2, "20", "99")})), (3, json.dumps({"batch": 3, "annotations": ok(3)}) + "}"),
        (4, json.dumps({"batch": 4, "annotations": ok(4, "40", "41", "40")})), (5, json.dumps({"batch": 5, "annotations": bad})), (7, "{}"),
    ]
    got = workbooks.assist_problems(inputs, spark.createDataFrame(outputs, "batch long, payload string"))
    assert rows_of(got) == sorted([
        (1, None, "batch field differs"), (1, None, "out of order"), (2, "21", "missing"), (2, "99", "unexpected"), (3, None, "unreadable output"), (4, "40", "comes twice"), (5, "50", "bad sentiment"), (5, "50", "bad aspect"), (5, "50", "bad aspect"),
        (5, "50", "evidence is not in the text"), (5, "50", "unknown flag"), (5, "50", "note is no text"), (6, None, "no output"), (7, None, "batch field differs"), (7, "70", "missing"),
    ], key=str)
    totals = workbooks.assist_totals(spark.createDataFrame(outputs[5:6], "batch long, payload string"), spark.createDataFrame([("fun",)], "aspect string"))
    assert totals.first().asDict() == {"batch": 5, "reviews": 2, "mentions": 4, "zero": 0, "flags": 2, "notes": 1, "candidates": 3}


@pytest.mark.parametrize("tail", ["}", "]", ",1", "]}", "}]", " x", ""])
def test_payloads_with_something_after(spark, tail):
    got = workbooks.annotations(spark.createDataFrame([(1, '{"batch": 1, "annotations": []} ' + tail), (2, None)], "batch long, payload string")).orderBy("batch").collect()
    assert [r.broken for r in got] == [bool(tail), True]


SHEET = """# Workbook
- a line before
## 1 · review a
- [x] reviewed
````text
## 9 · review z
````
- fun / positive / "good \\n fun"
- pace / mixed / (no span)
## 2 · review b
- [x] reviewed
SKIP: non_english
## 3 · review c
- [x] reviewed
Zero mentions.
## 4 · review d
- [ ] reviewed
Zero mentions.
"""


def test_gold_is_minted(spark):
    rows = files.sheets(spark.createDataFrame([("s", SHEET)], "file string, text string"))
    texts = spark.createDataFrame([(i, 1 + (i == "c"), f"text {i}") for i in "abcd"], "review_id string, app_id int, text string")
    gold = {r.review_id: [tuple(m) for m in r.mentions] for r in workbooks.gold_records(rows, texts).collect()}
    assert gold == {"a": [("fun", "positive", "good \n fun"), ("pace", "mixed", None)], "c": [], "d": []}
    replaced = spark.createDataFrame([("b", "c"), ("x", "d"), ("y", "b"), ("z", "nobody")], "review_id string, replacement_id string")
    assert rows_of(workbooks.mint_faults(rows, replaced)) == [("d", "not reviewed"), ("x", "replacement is not reviewed"), ("y", "replacement is skipped"), ("z", "replacement is missing")]
    pinned = spark.createDataFrame([("fun",)], "aspect string")
    total = workbooks.gold_summary(workbooks.gold_records(rows, texts), pinned).first()
    assert (total.records, total.mentions, total.zero, total.zero_share, total.positive, total.mixed, total.candidates) == (3, 2, 2, 0.667, 1, 1, 1)
    by = workbooks.gold_summary(workbooks.gold_records(rows, texts), pinned, "app_id")
    assert rows_of(by, "app_id", "records", "mentions", "candidates") == [(1, 2, 2, 1), (2, 1, 0, 0)]
    diff = spark.createDataFrame([("a", "difficulty", "modified", "mixed", "positive"), ("a", "fun", "modified", "mixed", "mixed"), ("a", "fun", "accepted", "mixed", "mixed")], "review_id string, aspect string, outcome string, was string, now string")
    assert rows_of(workbooks.flip_contrast(diff, workbooks.gold_records(rows, texts)), "disposition", "mentions", "flips") == [(False, 2, 0), (True, 0, 1)]


AUDIT = """before
- note: not a claim's
## 001 · first
review `r1` · mention `7`
> quoted
- aspect_supported: YES
- sentiment_supported:  unclear
- note: Keep Case
---
## 2 · skipped
SKIP: non_english.
## 3 · both
SKIP: empty_text
- aspect_supported: yes
## 4 · no id
- aspect_supported: yes
- sentiment_supported: no
## 5 · drifted
review `r5` · mention `1`
- aspect_supported: perhaps
odd line
## 6 · twice
review `r0` · mention `0`
review `r6` · mention `2`
- aspect_supported: no
- aspect_supported: yes
- sentiment_supported: no
- note:
"""


def test_audit_sheet(spark):
    got = workbooks.audit_sheets(spark.createDataFrame([("f", AUDIT), ("none", ""), ("null", None)], "file string, text string"))
    assert rows_of(got, "line", "item", "what", "review_id", "mention_id", "aspect_supported", "sentiment_supported", "note", "says") == sorted([
        (3, 1, "claim", "r1", "7", "yes", "unclear", "Keep Case", None), (10, 2, "skip", None, None, None, None, None, "non_english"), (12, 3, "problem", None, None, None, None, None, "skipped but carries verdicts"),
        (15, 4, "problem", None, None, None, None, None, "no id line"), (18, 5, "problem", None, None, None, None, None, "bad verdict aspect_supported: perhaps"), (18, 5, "problem", None, None, None, None, None, "unfilled verdict sentiment_supported"),
        (21, None, "problem", None, None, None, None, None, "unparseable line: odd line"), (22, 6, "claim", "r6", "2", "yes", "no", None, None),
    ], key=str)


def test_report_columns_both_ways(spark):
    at = datetime(2024, 1, 2, 3, 4, 5)
    kinds = ", ".join(f"{c} {t}" for c, t in columns.COLUMNS.items())
    row = (
        ("Said 5.", [(5, 6, "5", "numeral", 5.0, None)]), (3, "month", [(at, 1, 2)], [], [(1, at, at)], at), [(at, at, 2, 30, 4.5, True)], [("english", 4)], [(at, at, 9)], [(at, at, "whole")],
    )
    reports = spark.createDataFrame([row, (None,) * 6], kinds)
    wire = columns.encode_report(reports).collect()
    assert json.loads(wire[0].language_mix) == [{"language": "english", "count": 4}]
    assert json.loads(wire[0].narrative)["spans"][0] == {"start": 5, "end": 6, "text": "5", "kind": "numeral", "value": 5.0, "review_id": None}
    assert json.loads(wire[0].marked_windows) == [{"start": "2024-01-02T03:04:05+00:00", "end": "2024-01-02T03:04:05+00:00", "members_inside": 9}]
    assert rows_of(columns.decode_report(columns.encode_report(reports))) == rows_of(reports)
    for broken in ('[{"language": "english"}]', "[{", '[{"language": "english", "count": "many"}]'):
        with pytest.raises((PySparkException, Py4JJavaError)):
            spark.createDataFrame([(broken,)], "language_mix string").select(columns.decoded("language_mix", F.col("language_mix"))).collect()


def test_measurement_lines_and_manifest(spark, tmp_path):
    cells = spark.createDataFrame([(1, 10, "fun", 0.5, 0.9, 0.1, None, None), (1, 20, "fun", 0.5, 0.8, 0.2, 0.7, 0.3)], "app_id int, size int, aspect string, mean_error double, wilson_coverage double, wilson_mean_width double, stratified_coverage double, stratified_mean_width double")
    got = sorted((json.loads(r.line) for r in columns.measurement_lines(cells, ("app_id", "size")).collect()), key=lambda x: x["size"])
    assert got[0] == {"app_id": 1, "size": 10, "aspect": "fun", "mean_error": 0.5, "wilson": {"coverage": 0.9, "mean_width": 0.1}, "bootstrap": None, "stratified": None}
    assert got[1]["stratified"] == {"coverage": 0.7, "mean_width": 0.3}
    columns.write_manifest(spark.range(1).select(F.lit(3).alias("labeled"), F.lit(None).cast("int").alias("repairs")), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().asDict()["labeled"] == 3
    with pytest.raises(ValueError):
        columns.write_manifest(spark.range(2), str(tmp_path / "n"))


def test_probe_ranks_and_scopes(spark):
    draw = random.Random(2)
    calls = [(k, i, draw.choice([200, 500, None]), draw.randrange(30)) for k in "abc" for i in range({"a": 1, "b": 2, "c": 77}[k])]
    got = {r.k: r for r in scopes.probe_summary(spark.createDataFrame(calls, "k string, call_id int, status int, elapsed_ms int"), "k").collect()}
    for k in "abc":
        ms = sorted(c[3] for c in calls if c[0] == k)
        rank = lambda f: ms[min(len(ms) - 1, round(f * (len(ms) - 1)))]  # noqa: B023, E731
        assert (got[k].p50, got[k].p95, got[k].most, got[k].sent) == (rank(0.5), rank(0.95), ms[-1], len(ms))
        assert got[k].first_bad == next((c[1] for c in calls if c[0] == k and c[2] != 200), None)
    stored = spark.createDataFrame([("1", 1, " t "), ("2", 2, "u"), ("4", 9, "w")], "review_id string, app_id int, text string")
    gold = spark.createDataFrame([("1", 1, "t"), ("2", 2, "other"), ("3", 1, "t"), ("4", 9, "w")], "review_id string, app_id int, text string")
    assert rows_of(scopes.scope_faults(gold, stored, "gold")) == [("2", "another text"), ("3", "not stored")]
    with pytest.raises(ValueError, match="another text"):
        scopes.scope_reviews(gold, stored, "gold")
    assert rows_of(scopes.scope_reviews(gold.filter("review_id IN ('1', '4')"), stored, "gold", (9,)), "review_id") == [("1",)]


def test_rows_are_validated_as_they_are_read(spark):
    rows = spark.createDataFrame([("mixed", "2024-01-01T00:00:00Z")], "sentiment string, at string")
    good = scopes.validated(rows, {"sentiment": files.SENTIMENTS}, ("at",)).first()
    assert good.sentiment == "mixed" and good.at == datetime(2024, 1, 1)
    for s, t in (("angry", "2024-01-01"), (None, "2024-01-01"), ("mixed", "soon"), ("mixed", None)):
        with pytest.raises((PySparkException, Py4JJavaError)):
            scopes.validated(spark.createDataFrame([(s, t)], "sentiment string, at string"), {"sentiment": files.SENTIMENTS}, ("at",)).collect()
    ids = spark.range(1).select(scopes.run_id(F.lit("p"), F.lit(datetime(2024, 5, 6, 7, 8, 9))).alias("i")).first().i
    assert ids.startswith("p-20240506T070809Z-") and len(ids) == 27


def test_sheets_get_more_not_longer_as_tables_grow(spark, tmp_path):
    from hearsay.plans import workbooks as queries

    sf = "/root/testdata/sf0.001"
    for t in ("part", "lineitem", "orders"):
        d = spark.read.parquet(f"{sf}/{t}.parquet")
        if t != "part":
            key = "o_orderkey" if t == "orders" else "l_orderkey"
            d = d.unionByName(d.withColumn(key, F.col(key) + queries.SHEET_RANGE))
        d.write.parquet(f"{tmp_path}/{t}.parquet")
    longest = lambda d: d.agg(F.max(F.length("text"))).first()[0]
    for made in (queries._sheets, queries._audits):
        assert longest(made(spark, str(tmp_path))) < 1.2 * longest(made(spark, sf))


def test_plain_runs_are_those_of_a_scan_line_by_line(spark):
    import random

    rng = random.Random(5)
    kinds = ["```text", "````text", "```", "````", "## 1 · review 7", "## 2 · review 8", "- a / b / (no span)", "hm", ""]
    for _ in range(300):
        lines = rng.choices(kinds, k=rng.randrange(12))
        run, review, want = "", None, []
        for i, t in enumerate(lines, 1):
            if run:
                run = "" if t == run else run
            elif t.endswith("text"):
                run = t[:-4]
            else:
                review = t[-1] if t.startswith("##") else review
                want += [(i, review)] if review else []
        can = [(i, t[:-4] if t.endswith("text") else "", t, t[-1] if t.startswith("##") else "") for i, t in enumerate(lines, 1) if t[:2] in ("``", "##")]
        first, last, reviews, left, where = files._plain_runs(*([c[i] for c in can] for i in range(4)), len(lines))
        assert [(i, r) for a, z, r in zip(first, last, reviews) for i in range(a, z + 1)] == want and left == bool(run) and where == (review if run else None)


def test_assist_tables_are_read_once(spark, tmp_path):
    body = '{"batch": 1, "annotations": [{"mentions": []}, {"id": "a", "mentions": [{"aspect": "x", "sentiment": "odd", "evidence": "no"}]}]}'
    spark.createDataFrame([(1, body), (1, "{}x"), (3, "no")], "batch long, payload string").write.parquet(str(tmp_path / "o"))
    spark.createDataFrame([(1, 0, "a", "t"), (1, 1, "b", None), (2, 0, "c", "t")], "batch long, place long, review_id string, text string").write.parquet(str(tmp_path / "i"))
    got = workbooks.assist_problems(spark.read.parquet(str(tmp_path / "i")), spark.read.parquet(str(tmp_path / "o")))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    assert sorted((r.batch, r.review_id or "", r.problem) for r in got.collect()) == [
        (1, "", "unexpected"), (1, "", "unreadable output"), (1, "a", "bad sentiment"), (1, "a", "evidence is not in the text"), (1, "b", "missing"), (2, "", "no output"), (3, "", "unreadable output"),
    ]
