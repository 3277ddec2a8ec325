"""Ordered decisions over shuffled arrival, and followed logs, against batch folds."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hearsay.operators import logs
from hearsay.plans import streams
from hearsay.streaming import ordered, runs

SF = "/root/testdata/sf0.001"


def feed(spark, rows: pd.DataFrame, folder, schema, pieces: int, name: str = "p"):
    """Appends rows to a stream's folder as files that come one after the other."""
    folder.mkdir(exist_ok=True)
    n = len(list(folder.iterdir()))
    for i in range(pieces):
        part = rows.iloc[i * len(rows) // pieces : (i + 1) * len(rows) // pieces]
        part.to_parquet(folder / f"{n + i:04d}{name}.parquet", index=False, coerce_timestamps="us", allow_truncated_timestamps=True)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def shuffled(rows: pd.DataFrame, within: str, seed: int = 5) -> pd.DataFrame:
    """Rows in an order in which none comes later than ``within`` after a later one."""
    rng = random.Random(seed)
    delay = [pd.Timedelta(within) * rng.random() for _ in range(len(rows))]
    return rows.assign(_come=rows["at"] + pd.to_timedelta(delay)).sort_values("_come").drop(columns="_come")


def gate(asked: pd.DataFrame, per_ip: int, per_day: int, allowance: float) -> dict:
    """Guards asked in their order for one request after the other."""
    out, state = {}, {}
    for r in asked.sort_values(["at", "request_id"]).itertuples():
        day = state.setdefault(r.at.strftime("%Y-%m-%d"), {"used": {}, "live": {}, "n": 0, "spent": 0.0})
        if r.at < day["live"].get(r.visitor, r.at):
            out[r.request_id] = "in_flight"
        elif day["used"].get(r.visitor, 0) >= per_ip:
            out[r.request_id] = "ip_day_cap"
        elif day["n"] >= per_day:
            out[r.request_id] = "day_cap"
        elif day["spent"] >= allowance:
            out[r.request_id] = "backstop"
        else:
            out[r.request_id] = "admitted"
            day["used"][r.visitor] = day["used"].get(r.visitor, 0) + 1
            day["live"][r.visitor] = r.at + pd.Timedelta(seconds=r.seconds)
            day["n"] += 1
            day["spent"] += r.cost
    return out


@pytest.mark.parametrize(("per_ip", "per_day", "allowance"), [(2, 6, 100.0), (3, 100, 0.3)])
def test_admission_of_shuffled_requests(spark, tmp_path, per_ip, per_day, allowance):
    table = streams.requests(spark, SF).withColumn("visitor", (F.col("request_id") % 4).cast("string"))
    asked = table.toPandas()
    tick = pd.DataFrame({"request_id": [-1], "visitor": "tick", "at": asked["at"].max() + pd.Timedelta("2D"), "seconds": 0.0, "cost": 0.0})
    stream = feed(spark, pd.concat([shuffled(asked, "50 minutes"), tick]), tmp_path / "in", table.schema, 5)
    verdicts = runs.to_table(ordered.visitor_verdicts(stream, per_ip), str(tmp_path / "v"), str(tmp_path / "c1"))
    free = verdicts.filter("verdict = 'free'").join(table.select("request_id", "cost"), "request_id").select("request_id", "day", "at", "cost")
    late = free.toPandas()
    ticks = pd.DataFrame({"request_id": [-1], "day": "tick", "at": asked["at"].max() + pd.Timedelta("3D"), "cost": 0.0})
    stream = feed(spark, pd.concat([shuffled(late, "50 minutes", 6), ticks]), tmp_path / "free", free.schema, 3)
    closings = runs.to_table(ordered.pool_closings(stream, per_day, allowance), str(tmp_path / "p"), str(tmp_path / "c2"))
    got = {r.request_id: r.outcome for r in ordered.admitted(verdicts, closings, per_ip).collect()}
    want = gate(asked, per_ip, per_day, allowance)
    assert got == want
    assert {"admitted", "ip_day_cap", "in_flight", "day_cap" if per_day == 6 else "backstop"} <= set(want.values())


def test_late_row_of_a_closed_day_is_no_new_day(spark, tmp_path):
    """Two of a day use up its cap; a row of the day before, within the delay, takes nothing from it and reopens nothing."""
    at = pd.to_datetime(["2024-01-02 00:10", "2024-01-02 00:20", "2024-01-01 23:50", "2024-01-02 00:30", "2024-01-09 00:00"])
    rows = pd.DataFrame({"request_id": [1, 2, 3, 4, -1], "visitor": "v", "at": at, "seconds": 1.0, "cost": 0.0})
    schema = "request_id long, visitor string, at timestamp, seconds double, cost double"
    stream = feed(spark, rows, tmp_path / "in", schema, 5)
    verdicts = runs.to_table(ordered.visitor_verdicts(stream, 2), str(tmp_path / "v"), str(tmp_path / "c"))
    assert {r.request_id: r.verdict for r in verdicts.collect()} == {3: "free", 1: "free", 2: "free", 4: "ip_day_cap"}


def test_attachment_of_shuffled_requests(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    table = e.select(F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("app_id"), F.col("ts").cast("timestamp").alias("at"), F.lit(36_000.0).alias("seconds"))
    asked = table.toPandas()
    tick = pd.DataFrame({"request_id": [-1], "app_id": "tick", "at": asked["at"].max() + pd.Timedelta("3D"), "seconds": 0.0})
    stream = feed(spark, pd.concat([shuffled(asked, "50 minutes"), tick]), tmp_path / "in", table.schema, 4)
    got = runs.to_table(ordered.attachments(stream), str(tmp_path / "j"), str(tmp_path / "c")).groupBy("job").count().collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    assert sorted(map(tuple, got)) == sorted(db.execute(streams.ORACLE["live_attach"]).fetchall())


LOG = "job_id string, index long, at timestamp, event string, data string"


def in_order(df):
    """Frames of each job in the order of what they carry: ids ascend, and what has none stands between."""
    out = {}
    for r in df.collect():
        out.setdefault(r.job_id, []).append((r.id, r.event, r.data))
    return out


def counted(frames):
    return {job: sorted((str(f) for f in own)) for job, own in frames.items()}


def test_follow_equals_the_batch_fold(spark, tmp_path):
    """A replay of the first days, then live rows that overlap it, shuffled, some twice; a restart between; no gap, no repeat."""
    log = streams.job_log(spark, SF)
    whole = log.withColumn("index", F.expr("row_number() OVER (PARTITION BY job_id ORDER BY index) - 1").cast("long"))
    rows = whole.toPandas()
    edge, again = rows["at"].min() + pd.Timedelta("8D"), rows["at"].min() + pd.Timedelta("6D")
    replayed = whole.filter(F.col("at") < F.lit(edge))
    live = rows[rows["at"] >= again]
    live = shuffled(pd.concat([live, live.iloc[::7]]), "50 minutes")
    tick = pd.DataFrame({"job_id": ["tick"], "index": [0], "at": [rows["at"].max() + pd.Timedelta("1D")], "event": ["x"], "data": [""]})
    half = len(live) // 2
    beat = 3 * 3600
    sink, memory = str(tmp_path / "frames"), str(tmp_path / "c")
    for part in (live.iloc[:half], pd.concat([live.iloc[half:], tick])):  # the second run goes on from the first one's checkpoint
        stream = feed(spark, part, tmp_path / "in", LOG, 3)
        got = runs.to_table(ordered.follow(stream, replayed, beat), sink, memory)
    streamed = in_order(got.filter("job_id <> 'tick'"))
    shown = logs.frames(whole, beat).join(replayed.groupBy("job_id").agg(F.max("index").alias("seen")), "job_id", "left")
    # heartbeats after the replay's last row belong to what is followed
    ids = F.coalesce("id", F.when(F.col("event") == "end", 10**9))
    before = Window.partitionBy("job_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    following = shown.withColumn("known", F.coalesce(F.max(ids).over(before), F.lit(-1))).filter("known >= coalesce(seen, -1)")
    assert counted(streamed) == counted(in_order(following))
    for own in streamed.values():
        ids_ = [i for i, _, _ in own if i is not None]
        assert len(ids_) == len(set(ids_))
        assert sum(e == "end" for _, e, _ in own) == 1


def test_gap_is_told_once_the_watermark_has_passed_it(spark, tmp_path):
    t = pd.Timestamp("2024-01-01")
    minutes = lambda *m: [t + pd.Timedelta(minutes=x) for x in m]
    rows = pd.DataFrame({"job_id": "j", "index": [0, 2, 3, 1, 6, 7, 0], "at": minutes(0, 2, 3, 1, 60, 61, 5000), "event": ["a", "c", "d", "b", "g", "end", "x"], "data": "-"})
    rows.loc[6, "job_id"] = "tick"
    stream = feed(spark, rows, tmp_path / "in", LOG, 7)
    got = runs.to_table(ordered.follow(stream, None, 20 * 60, late="30 minutes"), str(tmp_path / "f"), str(tmp_path / "c"))
    own = in_order(got)["j"]
    assert sorted(own, key=str) == sorted([(0, "a", "-"), (1, "b", "-"), (2, "c", "-"), (3, "d", "-"), (None, "heartbeat", None), (None, "heartbeat", None), (None, "gap", "4..5"), (6, "g", "-"), (None, "end", "-")], key=str)


def test_batch_frames(spark):
    t = pd.Timestamp("2024-01-01")
    day = lambda s: (t + pd.Timedelta(seconds=s)).to_pydatetime()
    rows = [("j", 0, day(0), "a", None), ("j", 0, day(0), "a", None), ("j", 1, day(30), "b", "x"), ("j", 3, day(31), "end", "done"), ("j", 4, day(32), "late", "")]
    got = [tuple(r)[1:] for r in logs.frames(spark.createDataFrame(rows, LOG), 15).orderBy("place").collect()]
    assert got == [(0, 0, "a", None), (1, None, "heartbeat", None), (2, 1, "b", "x"), (3, None, "gap", "2..2"), (4, None, "end", "done")]
    assert logs.frames(spark.createDataFrame([], LOG), 15).collect() == []
