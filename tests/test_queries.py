"""Every registered query beside its SQL on the smallest tables, and guards of the operators."""

import duckdb
import pytest
from pyspark.sql import functions as F

from hearsay import registry
from hearsay.functions.intervals import share_band, wilson
from hearsay.operators import aggregates, grounding, sampling, selection, series
from verify_queries import plain

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in registry.oracle_sql():
        assert rows
        return
    cursor = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_wilson_golden_values(spark):
    low, high = wilson(F.lit(27), F.lit(100))
    r = one(spark, low.alias("a"), high.alias("b"), *(c.alias(n) for c, n in zip(wilson(F.lit(0), F.lit(0)), "cd", strict=True)))
    assert abs(r.a - 0.1928) < 1e-3 and abs(r.b - 0.3643) < 1e-3 and r.c is None and r.d is None


def test_bands(spark):
    r = one(spark, *(share_band(F.lit(x)).alias(n) for x, n in ((0.04, "a"), (0.05, "b"), (0.15, "c"))))
    assert tuple(r) == ("tail", "mid", "headline")


@pytest.mark.parametrize(
    ("populations", "kind", "n", "want"),
    [([60, 30, 10], "time-proportional", 10, [6, 3, 1]), ([5, 5, 5], "equal-per-window", 10, [4, 3, 3]), ([2, 100, 100], "equal-per-window", 30, [2, 14, 14]), ([2, 1], "time-proportional", 9, [2, 1])],
)
def test_apportionment_golden_values(spark, populations, kind, n, want):
    rows = [(1, "2020-0%d-01" % (i + 1), "2020-0%d-01" % (i + 2), p) for i, p in enumerate(populations)]
    windows = spark.createDataFrame(rows, "app_id long, start string, end string, population long")
    got = sampling.apportion(windows, n, kind).orderBy("start").collect()
    assert [r.quota for r in got] == want


def months(spark, volumes):
    rows = [(1, i, v) for i, v in enumerate(volumes)]
    return spark.createDataFrame(rows, "app_id long, i int, up long").select(
        "app_id", F.add_months(F.lit("2020-01-01").cast("date"), F.col("i")).cast("timestamp_ntz").alias("start"), "up", F.lit(0).cast("long").alias("down")
    )


def test_spike_golden_values(spark):
    found = series.episodes(series.spikes(months(spark, [100] * 6 + [1000]))).collect()
    assert [(r.n_buckets, r.n_reviews, r.top_ratio) for r in found] == [(1, 1000, 10.0)]
    found = series.episodes(series.spikes(months(spark, [60] * 6 + [1200]))).first()
    assert found.top_ratio == 20.0 and (found.end - found.start).days == 30 + (found.start.month == 8)
    assert series.episodes(series.spikes(months(spark, [100] * 5 + [1000]))).count() == 0
    with pytest.raises(ValueError):
        series.spikes(months(spark, [1]), trailing=0)


def test_mint_counts_empty_envelopes_and_no_row_twice(spark):
    env = spark.createDataFrame([(str(i), 1, "survey", "lexicon", "p1", "v2") for i in range(4)] + [("9", 1, "investigation", "lexicon", "p1", "v2")],
                                "review_id string, app_id long, origin string, model_version string, prompt_version string, ontology_version string")
    men = spark.createDataFrame([("0", "a", "pinned", "positive"), ("0", "a", "pinned", "negative"), ("1", "a", "pinned", "mixed"), ("9", "a", "pinned", "mixed")],
                                "review_id string, aspect string, slot string, sentiment string")
    r = aggregates.mint(env, men).collect()
    assert len(r) == 1 and (r[0].n_reviews, r[0].sample_size, r[0].share, r[0].n_negative) == (2, 4, 0.5, 1)
    assert aggregates.mint(env, men, floor=3).count() == 0


def test_double_anti_join(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "review_id string")
    env = spark.createDataFrame([("1", "survey", "lexicon", "p1", "v2"), ("2", "survey", "lexicon", "p1", "v1")],
                                "review_id string, origin string, model_version string, prompt_version string, ontology_version string")
    assert sorted(r.review_id for r in selection.unlabeled(ids("1", "2", "3", "4"), env, ids("3")).collect()) == ["2", "4"]


def test_pins_match_drift_or_miss(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, text string")
    pins = spark.createDataFrame([(1, "a"), (2, "x"), (9, "c")], "doc_id long, text string").select("doc_id", F.sha2("text", 256).alias("pin"))
    got = grounding.checked_pins(pins, texts, "doc_id").collect()
    assert {r.doc_id: r.outcome for r in got} == {1: "matching", 2: "drifted", 9: "missing"}
    assert {r.outcome for r in registry.queries()["text_pins"](spark, SF).collect()} == {"matching", "drifted", "missing"}
