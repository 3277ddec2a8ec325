import pandas as pd

from hearsay.streaming import events as ev

EVENTS = "/root/testdata/sf0.001/events.parquet"


def folder(spark, tmp_path):
    """The events in three files, in the order of time."""
    rows = spark.read.parquet(EVENTS).toPandas().sort_values("ts")
    at = tmp_path / "in"
    at.mkdir()
    for i in range(3):
        rows.iloc[i * len(rows) // 3 : (i + 1) * len(rows) // 3].to_parquet(at / f"{i}.parquet", coerce_timestamps="us")
    return str(at), rows


def test_daily_counts_close_with_the_watermark(spark, tmp_path):
    at, rows = folder(spark, tmp_path)
    schema = spark.read.parquet(at).schema
    got = ev.run_once(ev.daily_counts(ev.read(spark, at, schema)), "daily", str(tmp_path / "c")).toPandas()
    want = rows.groupby([rows.ts.dt.floor("D"), "event_type"]).size()
    last = rows.ts.max() - pd.Timedelta("2D")
    assert len(got) and all(want[(r.day, r.event_type)] == r.n for r in got.itertuples())
    assert got.day.max() <= last


def test_deduplication(spark, tmp_path):
    at, rows = folder(spark, tmp_path)
    rows.head(50).to_parquet(tmp_path / "in" / "3.parquet", coerce_timestamps="us")
    schema = spark.read.parquet(at).schema
    twice = spark.read.parquet(at).count()
    got = ev.run_once(ev.deduplicated(ev.read(spark, at, schema, 10)), "once", str(tmp_path / "c"))
    assert twice == len(rows) + 50 and got.count() == len(rows)
