"""The retry ladder over a stream: resumable passes, equal however often a run is stopped."""

import pytest
from pyspark.sql import functions as F

from hearsay.streaming import passes


class Stop(RuntimeError):
    pass


def members(spark, tmp_path, first, last, name):
    rows = spark.range(first, last).select(F.col("id").cast("string").alias("review_id"), F.concat(F.lit("says "), "id").alias("text"))
    rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return rows.schema


def answer(calls, stop_at=None):
    """Bad for ids that 5 divides unless alone, always for 7; the whole reply of the first batch of a pass is broken."""

    def reply(asked):
        calls.append(sorted(r.review_id for r in asked.select("review_id").collect()))
        if stop_at == len(calls):
            raise Stop
        r = F.col("review_id").cast("long")
        mood = F.when((r == 7) | (r % 5 == 0) & (F.col("size") > 1), "furious").otherwise("negative")
        item = F.struct(F.lit("Load Time").alias("aspect"), mood.alias("sentiment"), F.when(r % 2 == 0, F.lit("other")).otherwise(F.col("text")).alias("evidence"))
        rows = asked.select("batch", "size", F.struct("idx", F.array(item).alias("aspects")).alias("o")).groupBy("batch", "size")
        whole = rows.agg(F.to_json(F.array_sort(F.collect_list("o"))).alias("t"))
        return whole.select("batch", "size", F.when((F.col("batch") == 0) & (F.col("size") > 1), "no list").otherwise(F.col("t")).alias("reply"))

    return reply


def run(spark, tmp_path, name, stop_at=None, known=None):
    calls = []
    index = spark.createDataFrame([("load time", "loading")], "key string, label string")
    ladder = passes.Passes(spark, str(tmp_path / name), answer(calls, stop_at), index, 4, known)
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    ladder.follow(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / f"{name}-c"))
    ladder.finish()
    return ladder, calls


def result(ladder):
    return (
        sorted(map(tuple, ladder.mentions().collect()), key=str), sorted(map(tuple, ladder.failures().collect())), sorted(map(tuple, ladder.outcomes().collect())), tuple(ladder.totals().first()),
    )


def test_ladder_and_stops(spark, tmp_path):
    for k in range(2):
        members(spark, tmp_path, 1 + 8 * k, 11 + 8 * k, str(k))  # ids 9 and 10 come twice
    ladder, calls = run(spark, tmp_path, "whole")
    want = result(ladder)
    by_step = {r[0]: (r[1], r[2]) for r in want[2]}
    assert len(by_step) == 18 and by_step["7"] == ("isolate", False) and all(ok for r, (_, ok) in by_step.items() if r != "7")
    assert [f[0] for f in want[1]] == ["7"] and len(want[0]) == 17
    assert {m[1:3] for m in want[0]} == {("loading", "pinned")}
    assert want[3][:3] == (18, 17, 1) and want[3][4] == len(calls[-1]) and want[3][6] == sum(int(r) % 2 == 0 for r in by_step)
    assert sum(len(c) for c in calls[:2]) == 18  # nothing that came twice is asked twice
    assert len(calls) == 4
    for stop_at in (2, 3):  # between micro-batches, and before the second pass
        name = f"stop{stop_at}"
        with pytest.raises(Exception):  # noqa: B017  (Spark wraps what a micro-batch raises)
            run(spark, tmp_path, name, stop_at)
        again, more = run(spark, tmp_path, name)
        assert result(again) == want
        assert more == calls[stop_at - 1 :]  # what was bought is not bought again


def test_known_labels_are_not_asked_again(spark, tmp_path):
    members(spark, tmp_path, 1, 11, "0")
    known = spark.createDataFrame([("1",), ("2",), ("7",)], "review_id string")
    ladder, calls = run(spark, tmp_path, "known", known=known)
    assert not {"1", "2", "7"} & set(calls[0]) and ladder.failures().count() == 0


def test_nothing_to_do(spark, tmp_path):
    members(spark, tmp_path, 1, 1, "0")
    ladder, _ = run(spark, tmp_path, "none")
    assert result(ladder)[:3] == ([], [], []) and result(ladder)[3] == (0, 0, 0, 0, 0, 0, 0)
