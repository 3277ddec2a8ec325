"""Prose cut at quotations, numerals and sentences; strings searched in texts; label sheets."""

import re

import pytest

from hearsay.functions import search
from hearsay.functions import text as tx
from hearsay.operators import grounding
from hearsay.sources import files

PROSE = [
    'He said "it is 12 high." Then 1,234.5 more.', 'A "b', "", 'no 1 "2" 3 "4', '"a" "b" "', 'It costs 3. "Too high." and 99 agreed. Next!', 'One "two. three! four?" Five. 6', "Wait... what?! Yes", 'x."y" z', 'End of it."', '99', 'é 5 "ü 6." É 7',
]


def scanned(text):
    """One character after the other."""
    out, at, marks = [], 0, [i for i, c in enumerate(text) if c == '"']
    pairs = [(marks[i], marks[i + 1]) for i in range(0, len(marks) - 1, 2)]
    out += [(a, z + 1, "quote") for a, z in pairs]
    if len(marks) % 2:
        out.append((marks[-1], marks[-1] + 1, "unpaired"))
    while at < len(text):
        hit = re.match(tx.NUMERAL, text[at:])
        if hit and not any(a < at < z for a, z in pairs):
            out.append((at, at + hit.end(), "numeral"))
            at += hit.end()
        else:
            at += 1
    return sorted(out)


def test_spans_of_prose(spark):
    rows = spark.createDataFrame([(i, "g", t) for i, t in enumerate([*PROSE, None])], "id long, by string, text string")
    got = {}
    for r in tx.prose_spans(rows, "id", "by").collect():
        got.setdefault(r.id, []).append((r.start, r.end, r.kind))
        assert PROSE[r.id][r.start : r.end] == r.span and r.by == "g"
    assert {i: sorted(v) for i, v in got.items()} == {i: scanned(t) for i, t in enumerate(PROSE) if scanned(t)}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("One. Two! Three", ["One. ", "Two! ", "Three"]), ('He says "no. never!" Then goes.', ['He says "no. never!" ', "Then goes."]), ('It is "too high." and 99 agreed. Next', ['It is "too high." and 99 agreed. ', "Next"]),
        ("Wait... what?! Yes", ["Wait... ", "what?! ", "Yes"]), ("v1.2 is out.", ["v1.2 is out."]), ('Stop. "A. B." "C."', ["Stop. ", '"A. B." ', '"C."']), ('It ends."', ['It ends."']), ('A b." C', ['A b." ', "C"]), ("", []), ('Too "high. Very." Next', ['Too "high. Very." ', "Next"]), ('"a." and b. C', ['"a." and b. ', "C"]), ("a\n\nb.\n c", ["a\n\nb.\n ", "c"]),
    ],
)
def test_sentences(spark, text, want):
    got = tx.sentences(spark.createDataFrame([(1, text)], "id long, text string"), "id").orderBy("place").collect()
    assert [r.sentence for r in got] == want and "".join(want) == text
    assert [text[r.start : r.end] for r in got] == want


def test_cut_and_regrounding(spark):
    prose = spark.createDataFrame([(1, "One 1. Two 2. Three 3."), (2, "Only 9."), (3, None), (4, "")], "id long, text string")
    spans = spark.createDataFrame([(1, 4, 5, None), (1, 11, 12, "bad"), (2, 5, 6, "bad"), (2, 5, 6, "worse")], "id long, start int, end int, reason string")
    assert {r.id: r.cut for r in grounding.cut_violations(prose, spans, "id").collect()} == {1: "One 1. Three 3.", 2: "", 3: None, 4: ""}
    plan = sorted(tuple(r) for r in grounding.regrounding(prose, spans, "id").collect())
    assert plan == [(1, 1, "Two 2.", "bad", "cut"), (2, 0, "Only 9.", "bad; worse", "withhold")]


def test_search_in_blocks(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "abcabc", "x"), (2, "bc", "y"), (3, None, None), (4, "", "z"), (5, "bc", "y")], "id long, text string, more string")
    strings = spark.createDataFrame([("abc",), ("bc",), ("c",), ("",), (None,), ("bc",), ("zz",)], "s string")
    want = sorted([(1, "x", "abc"), (1, "x", "bc"), (1, "x", "c"), (2, "y", "bc"), (2, "y", "c"), (5, "y", "bc"), (5, "y", "c")])
    assert sorted(map(tuple, search.parts_of(texts, "text", strings, "s").collect())) == want
    monkeypatch.setattr(search, "BLOCK", 2)
    assert sorted(map(tuple, search.parts_of(texts, "text", strings, "s").collect())) == want
    assert search.parts_of(texts, "text", strings.limit(0), "s").collect() == []


@pytest.mark.parametrize(("token", "value"), [("i", 1), ("iv", 4), ("vi", 6), ("ix", 9), ("xiv", 14), ("xxxix", 39), ("iix", 8), ("vx", 5), ("vix", 4)])
def test_roman(spark, token, value):
    from pyspark.sql import functions as F

    assert spark.range(1).select(tx.numeral_signature(F.lit(token)).alias("v")).first().v == [value]


SHEET = """A preamble.
- not yet / a / mention
## 1 · review 11
- [x] reviewed
> a note
````text
## 2 · review 99
```
- in / the / "text"
````
- story / positive / "a \\n \"b\" c"
- pace / mixed / (no span)
- short / mixed
- none / mixed / no marks
---
## 2 · review 12
- [ ] reviewed
```text
```
SKIP: non_english.
## 3 · review 13
- [x] reviewed
Zero mentions.
what is this
## 4 · review 14
```text
never closed
"""


def test_sheet(spark):
    rows = files.sheets(spark.createDataFrame([("f", SHEET), ("empty", ""), ("g", "## 1 · review 7\r\n- [x] reviewed\r\nZero mentions.")], "file string, text string"))
    got = sorted((r.file, r.line, r.review_id, r.what, r.aspect, r.sentiment, r.evidence) for r in rows.collect() if r.what not in ("review", "checked"))
    assert [g[:6] for g in got] == [
        ("f", 11, "11", "mention", "story", "positive"), ("f", 12, "11", "mention", "pace", "mixed"), ("f", 13, "11", "problem", "malformed mention line: - short / mixed", None),
        ("f", 14, "11", "problem", "malformed mention line: - none / mixed / no marks", None), ("f", 20, "12", "skip", "non_english", None), ("f", 23, "13", "zero", None, None),
        ("f", 24, "13", "problem", "what is this", None), ("f", 28, "14", "problem", "the last fence is open", None), ("g", 3, "7", "zero", None, None),
    ]
    assert got[0][6] == 'a \n "b" c' and got[1][6] is None
    assert sorted((r.file, r.review_id) for r in files.unchecked(rows).collect()) == [("f", "12"), ("f", "14")]
    texts = spark.createDataFrame([("11", 'a \n "b" c'), ("12", ""), ("13", "x"), ("7", "y")], "review_id string, text string")
    problems = sorted((r.review_id, r.problem) for r in files.sheet_problems(rows, texts).collect())
    assert ("14", "unknown review") in problems and ("12", "not reviewed") in problems and ("13", "cannot be read: what is this") in problems
    mentions, skips = files.sheet_reference(rows)
    assert mentions.count() == 2 and [tuple(r) for r in skips.collect()] == [("12", "non_english")]


def test_sentences_do_not_reach_over_line_ends(spark, tmp_path):
    import duckdb

    from hearsay.plans import prose

    blanks = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x85", "\xa0", "\u2028", "\u3000", "\t", " "]
    texts = [t for w in blanks for t in (f"aa bb cc dd{w}hello world again. More", f"One. {w}bb cc dd hello{w}{w} ee {w}! gg", f"One.{w} bb{w} cc dd {w}hello{w} ee {w}")]
    texts += ["a b c d " + "x" * n + " tail words" for n in (280, 299, 300, 301, 400)] + ["a b c d hello " + "word " * 100, "word " * 3 + "l" * 400 + " hello", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.span, r.shown) for r in prose.sentence_quotes(spark, str(tmp_path)).collect()}
    assert got[0] == ("hello", "hello world again.")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == {r[0]: (r[1], r[2]) for r in db.execute(prose.ORACLE["sentence_quotes"]).fetchall()}


def test_bracketed_pieces_are_places_of_the_reply(spark):
    from hearsay.operators import replies

    said = ['Sure \U0001f600. [{"idx": 0, "aspects": [["é"], ["\U0001f44d ]"]]}] hope [1', "none [here", "[x] then [[1], 2]", "so [1] [2]", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, reply string")
    got = {r.i: r.payload for r in replies.with_payload(rows).collect()}
    assert got == {0: '[{"idx": 0, "aspects": [["é"], ["\U0001f44d ]"]]}]', 1: None, 2: "[[1], 2]", 3: "[1]", 4: None}
    places = rows.filter("i = 2").select(replies.bracketed("reply").alias("p")).first().p
    assert [list(p) for p in places] == [[1, 3], [10, 8], [11, 3]]  # a piece costs two numbers, however long it is
