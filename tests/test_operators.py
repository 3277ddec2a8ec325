"""Golden values and guards of the operators behind the queries."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hearsay.functions import dates, geometry
from hearsay.functions import intervals as iv
from hearsay.functions import text as tx
from hearsay.operators import certify, display, doors, grounding, replies, studies
from hearsay.sources import files, payloads


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_names(spark):
    names = ["Team Fortress 2", "NieR:Automata™", "Pokémon", "東方紅魔郷"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i long, n string")
    got = rows.select("i", tx.slug(F.col("n")).alias("s"), tx.report_path(F.col("i"), F.col("n")).alias("p"), tx.plain_name("n").alias("q")).orderBy("i").collect()
    assert [r.s for r in got] == ["team-fortress-2", "nier-automata", "pokemon", ""]
    assert got[0].p == "/reports/0/team-fortress-2" and got[3].p == "/reports/3" and got[2].q == "pokemon"
    pairs = [("Fallout 3", "Fallout 4", "mismatch"), ("Half-Life 2", "Half-Life II", "ok"), ("Rust", None, "no-data"), ("Rust", "Rusty Lake", "mismatch"), ("Dark Souls II", "Dark Souls III", "mismatch"),
             ("Deep Rock", "Deep Rock: Supporter Edition", "ok"), ("Civilization V", "Civilization VI", "mismatch")]
    got = spark.createDataFrame([p[:2] for p in pairs], "a string, b string").select(tx.same_name(tx.plain_name("a"), tx.plain_name("b")).alias("v")).collect()
    assert [r.v for r in got] == [p[2] for p in pairs]


def test_labels(spark):
    v = spark.createDataFrame([("voice_acting", ["voices"]), ("combat", ["fighting", "ｃｏｍｂａｔ"])], "label string, aliases array<string>")
    raw = spark.createDataFrame([(x,) for x in (" Voice-Acting ", "Ship  Building", "Base_Building", "Co-Op  partner", "com​bat", " - ")], "aspect string")
    got = {r.aspect: r.slot for r in replies.normalized(raw, replies.surface_index(v)).collect()}
    assert got == {"voice_acting": "pinned", "combat": "pinned", "ship building": "candidate", "base building": "candidate", "co-op partner": "candidate", None: None}
    clash = replies.collisions(v.unionByName(spark.createDataFrame([("fights", ["Fighting"])], "label string, aliases array<string>"))).collect()
    assert [(r.key, r.labels) for r in clash] == [("fighting", ["combat", "fights"])]


def judged(spark, text, values, evidence=()):
    prose = spark.createDataFrame([(1, 1, text)], "id long, app_id long, text string")
    facts = spark.createDataFrame([(1, float(v)) for v in values], "app_id long, value double")
    pool = spark.createDataFrame([(1, r, t) for r, t in evidence], "app_id long, review_id string, text string")
    return prose, grounding.grounded(prose, facts, pool, "id", "app_id")


@pytest.mark.parametrize(
    ("text", "values", "bad"),
    [
        ("Performance comes up in 273 reviews.", [273.0], []), ("Roughly 40% complain.", [27.3], ["40"]), ("27 or 27.3 or 27.0", [27.3], ["27.0"]), ("1,234.5 and 2.50000", [1234.5, 2.5], []),
        ("half: 0.125 is 0.13, not 0.12", [0.125], ["0.12"]), ('He says "in 99 hours" and 98', [98.0], ['"in 99 hours"']), ('an odd " mark', [], ['"']), ('"..." it is', [], ['"..."']),
    ],
)
def test_grounding(spark, text, values, bad):
    _, spans = judged(spark, text, values, [("r1", "other words")])
    assert sorted(r.span for r in spans.filter("reason IS NOT NULL").collect()) == sorted(bad)


def test_grounding_takes_the_least(spark):
    prose, spans = judged(spark, 'One wrote “asking price is far too high,” and 27 left. Roughly 40% did.', [27.4, 26.9], [("r2", "the asking price is far too high"), ("r1", "my asking price is far too high!")])
    got = {r.span: (r.value, r.review_id) for r in spans.filter("reason IS NULL").collect()}
    assert got == {'"asking price is far too high,"': (None, "r1"), "27": (26.9, None)}
    assert grounding.cut_violations(prose, spans, "id").first().cut.endswith("27 left.")


def test_replies(spark):
    texts = spark.createDataFrame([(1, 0, "the combat is fine"), (1, 1, "b"), (1, 2, "c"), (2, 0, "d")], "batch long, idx long, text string")
    index = spark.createDataFrame([("combat", "combat")], "key string, label string")
    item = lambda a, s, e=None: {"aspect": a, "sentiment": s} | ({"evidence": e} if e is not None else {})
    body = [{"idx": 0, "aspects": [item("Combat", "positive", "combat is"), item("combat", "negative", ""), item("new thing", "mixed", "not there")]}, {"idx": 1, "aspects": "x"}, {"idx": True, "aspects": []}, "y", {"idx": 7, "aspects": []}]
    rows = spark.createDataFrame([(1, 3, "Well [here]:\n```json\n" + json.dumps(body) + "\n```"), (2, 1, "nothing")], "batch long, size int, reply string")
    mentions, failures, repairs = replies.parsed(rows, texts, index)
    assert sorted((r.aspect, r.slot, r.sentiment, r.evidence) for r in mentions.collect()) == [("combat", "pinned", "mixed", "combat is"), ("new thing", "candidate", "mixed", None)]
    assert [(r.aspect, r.evidence) for r in repairs.collect()] == [("new thing", "not there")]
    got = sorted((r.batch, -1 if r.idx is None else r.idx, r.reason) for r in failures.collect())
    assert got == [(1, -1, "bad idx"), (1, -1, "out of range"), (1, 1, "aspects is no list"), (1, 2, "missing"), (2, 0, "not valid JSON")]


@pytest.mark.parametrize(
    ("reply", "payload"),
    [
        ('{"a": 1}', '{"a": 1}'), ("a [1, 2] b [3", "[1, 2]"), ("no", None), ("", None), (None, None), ("see [here] and [1]", "[1]"), ('say "[" then [{"a": "x ] y"}] end', '[{"a": "x ] y"}]'),
        ("[open and [[2], 3] after", "[[2], 3]"), ("one ```json\n[1,\n```\ntwo ```\n[2]\n``` [3]", "\n[2]\n"), ("```json\n[4]\n```", "[4]\n"), ('x [{"a": "q\\\\"}] [5]', '[{"a": "q\\\\"}]'), ("```json\n[6]", "[6]"),
    ],
)
def test_payload_of_a_reply(spark, reply, payload):
    got = replies.with_payload(spark.createDataFrame([(1, reply)], "batch long, reply string")).first().payload
    assert (got if got is None else json.loads(got)) == (payload if payload is None else json.loads(payload))


def test_intervals(spark):
    rows = spark.createDataFrame([(50, 100), (0, 200), (7, 7)], "k long, n long")
    got = {r.k: (r.exact_low, r.exact_high) for r in iv.exact_bounds(rows, "k", "n").collect()}
    assert got == {50: (0.4, 0.6), 0: (0.0, 0.0), 7: (1.0, 1.0)}
    calm, spiky = iv.shipped(F.lit(270), F.lit(1000), F.lit("calm")), iv.shipped(F.lit(270), F.lit(1000), F.lit("spiky"))
    r = one(spark, a=calm[0] - spiky[0], b=spiky[1] - calm[1], c=iv.needed_inflation(F.lit(0.3), F.lit(0.2)), d=iv.tolerance(F.lit("calm"), F.lit("mid")), e=iv.tolerance(F.lit("spiky"), F.lit("mid")))
    assert round(r.a, 3) == round(r.b, 3) == 0.127 and round(r.c, 9) == 0.2 and r.d == 0.025 and r.e is None
    with pytest.raises(PySparkException):
        one(spark, x=iv.guarded(F.lit(3), F.lit(2)))


def test_dates_and_geometry(spark):
    t = F.lit("2026-07-14 12:30:00").cast("timestamp")
    r = one(spark, a=dates.iso_text(t), b=dates.quota_start(t, 13).cast("timestamp_ntz"), c=dates.elapsed(t, t + F.expr("interval 192 seconds")), d=dates.elapsed(t, F.lit(None)), e=geometry.axis_ceiling(F.lit(0.3)), f=geometry.axis_ceiling(F.lit(0.31)), g=geometry.volume_step(F.lit(3)), h=geometry.volume_step(F.lit(900)))
    assert (r.a, r.c, r.d, r.e, r.f, r.g, r.h) == ("2026-07-14T12:30:00.000000+00:00", "3m 12s", "—", 0.3, 0.4, 1, 500) and str(r.b) == "2026-07-13 13:00:00"
    with pytest.raises(PySparkException):
        one(spark, x=dates.iso_time(F.lit("2026-07-14T12:30:00")))


def test_studies(spark):
    reads = spark.createDataFrame([(1, s, None if s == 0 else 0.99, c) for s, c in ((0.0, 0.97), (0.02, 0.96), (0.05, 0.9), (0.1, 0.99))] + [(2, 0.0, None, 0.5), (3, 0.0, None, 1.0)], "source long, share double, tolerance_rate double, coverage_rate double")
    got = {r.source: (r.floor, r.censored) for r in studies.floors(reads).collect()}
    assert got == {1: (0.02, False), 2: (None, False), 3: (0.0, True)}
    sample = spark.createDataFrame([(1, f"s{i}") for i in range(10)], "app_id long, review_id string")
    marked = spark.createDataFrame([(1, f"m{i}") for i in range(4)], "app_id long, review_id string")
    got = studies.contaminated(sample, marked, [0.0, 0.05, 0.25], "x").groupBy("share").agg(F.count("*").alias("n"), F.count_if(F.col("review_id").startswith("m")).alias("m")).collect()
    assert {r.share: (r.n, r.m) for r in got} == {0.0: (10, 0), 0.05: (10, 1), 0.25: (10, 3)}
    for bad in (0.5, 0.96):
        with pytest.raises(PySparkException):
            studies.contaminated(sample, marked, [bad], "x").collect()
    with pytest.raises(PySparkException):
        studies.contaminated(sample, sample, [0.1], "x").collect()
    needed = spark.createDataFrame([("calm", "tail", 10, i / 100) for i in range(20)], "regime string, band string, size int, needed double")
    assert {r.regime: r.allowance for r in studies.flat_allowances(needed).collect()} == {"calm": 0.18, "flat": 0.18}


def test_paired_draws_are_shared(spark):
    rows = spark.createDataFrame([(r, str(i), i % 3, 1, 1) for r in "ab" for i in range(300)], "run string, review_id string, tp long, fp long, fn long")
    got = certify.paired_bootstrap(rows, certify.f1_of(F.col("tp"), F.col("fp"), F.col("fn")), ["tp", "fp", "fn"], "a", "b", resamples=50, buckets=64).first()
    assert (got.difference, got.low, got.high, got.read) == (0.0, 0.0, 0.0, "indistinguishable")
    sparse = rows.filter("run = 'a' AND review_id = '0'").withColumn("tp", F.lit(0)).withColumn("fp", F.lit(0)).withColumn("fn", F.lit(0))
    assert certify.bootstrap(sparse, certify.f1_of(F.col("tp"), F.col("fp"), F.col("fn")), ["tp", "fp", "fn"], resamples=20, buckets=8).first().low is None


def test_display(spark):
    r = one(spark, d=display.dominant({s: F.lit(n) for s, n in zip(display.LOUDEST, (2, 7, 1, 0), strict=True)}), e=display.dominant({s: F.lit(3) for s in display.LOUDEST}), q=display.exclusive_quartiles(F.array(*map(F.lit, (1, 2, 3, 4)))), b=display.list_band(F.lit(2000)), n=display.list_band(F.lit(199)))
    assert (r.d, r.e, r.q, r.b, r.n) == ("negative", "positive", [1.25, 2.5, 3.75], "true-tail", None)
    s = one(spark, s=tx.containing_sentence(F.lit("runs"), F.lit("Bad. It runs well!\nMore")), f=tx.fence_for(F.lit("a ```` b")), v=tx.visitor(F.lit("9.9.9.9, 1.2.3.4"), F.lit("p")), w=tx.visitor(F.lit(None).cast("string"), F.lit("p")))
    assert (s.s, s.f, s.v, s.w) == ("It runs well!", "`````", "1.2.3.4", "p")


def test_payloads_are_guarded(spark):
    rows = lambda *p: spark.createDataFrame([(1, x) for x in p], "app_id long, payload string")
    page = payloads.review_pages(rows('{"success": 1}', '{"success": 2, "query_summary": {"num": 1}}')).orderBy("success").collect()
    assert [(r.success, r.reviews, r.total_reviews) for r in page] == [(1, [], None), (2, [], None)]
    for bad in ('{"success": true}', '{"success": 1, "reviews": 3}', '{"success": 1, "reviews": [{"recommendationid": "1", "timestamp_created": 5, "voted_up": 1}]}'):
        with pytest.raises(PySparkException):
            payloads.review_pages(rows(bad)).collect()
    with pytest.raises(PySparkException):
        payloads.histograms(rows('{"success": 1, "results": {"rollup_type": "day", "rollups": [], "recent": []}}')).collect()
    assert payloads.app_details(rows('{"1": null}', '{"1": {"success": false}}')).collect() == []
    with pytest.raises(PySparkException):
        payloads.app_details(rows('{"2": {}}')).collect()


VOCABULARY = '''version = "v9"
categories = ["play"]
[[aspects]]
label = "combat"
category = "play"
definition = "Fights, see `story`."
aliases = ["fighting"]
label_when = "x"
do_not_label_when = "y"
examples = ["z"]
[[aspects]]
label = "story"
category = "{0}"
definition = "Plot."
aliases = ["{1}"]
label_when = "x"
do_not_label_when = "y"
examples = ["`combat`"]
'''


def test_vocabulary(spark, tmp_path):
    good, bad = tmp_path / "good.toml", tmp_path / "bad.toml"
    good.write_text(VOCABULARY.format("play", "plot"))
    bad.write_text(VOCABULARY.format("work", "Fighting"))
    assert [r.label for r in files.vocabulary(spark, str(good)).orderBy("place").collect()] == ["combat", "story"]
    assert files.content_stamp(spark, str(good))[0] == "v9"
    with pytest.raises(ValueError, match="(?s)an alias of several labels.*category not declared"):
        files.vocabulary(spark, str(bad))


def test_doors(spark, tmp_path):
    rows = spark.createDataFrame([("1",), ("2",)], "review_id string")
    none = doors.insert_faults(rows.limit(0), rows, ["review_id"])
    assert doors.append(rows, none, str(tmp_path / "t")) == 2 and spark.read.parquet(str(tmp_path / "t")).count() == 2
    with pytest.raises(ValueError):
        doors.append(rows, doors.insert_faults(rows, rows, ["review_id"]), str(tmp_path / "t"))


def relations(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_replies_are_read_once(spark, tmp_path):
    spark.createDataFrame([(1, 2, '[{"idx": 0, "aspects": []}]'), (1, 1, "no"), (2, 1, '{"a": 1}')], "batch long, size int, reply string").write.parquet(str(tmp_path / "r"))
    spark.createDataFrame([(1, 0, "a")], "batch long, idx long, text string").write.parquet(str(tmp_path / "t"))
    rows, texts = spark.read.parquet(str(tmp_path / "r")), spark.read.parquet(str(tmp_path / "t"))
    index = spark.createDataFrame([("combat", "combat")], "key string, label string")
    mentions, failures, repairs = replies.parsed(rows, texts, index)
    assert relations(failures) == 1 and relations(mentions) == 2 and relations(repairs) == 2
    found = replies.found(rows, texts, index)
    assert relations(found) == 2
    want = [(1, 0, "not valid JSON"), (1, 1, "missing"), (2, 0, "not a JSON array")]
    assert sorted(tuple(r) for r in failures.collect()) == want
    assert sorted((r.batch, r.idx, r.reason) for r in found.collect()) == want and not mentions.collect()


@pytest.mark.parametrize("n", [0, 1, 5, 25, 3000])
def test_numbered_finds_ranges_by_bisection(spark, n):
    from hearsay.operators.selection import numbered

    got = numbered(spark.range(n).select((F.col("id") % 7).alias("a"), F.col("id").cast("string").alias("b")), ["a", "b"])
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.a, r.b) for r in sorted(got.collect(), key=lambda r: r._place)] == sorted((i % 7, str(i)) for i in range(n))
    assert sorted(r._place for r in got.collect()) == list(range(n))
