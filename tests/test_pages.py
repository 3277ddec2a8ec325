"""Newest-first walks over captured pages: stops, precedence, and the data source in batch and as a stream."""

import json

import pytest
from pyspark.errors import PySparkException

from hearsay.sources import pages
from hearsay.streaming import runs


def answer(asked, ats, following=None, total=None, success=1):
    return {"asked": asked, "success": success, "next": following, "total": total, "reviews": [{"id": f"r{t}", "at": t, "language": "english", "up": True} for t in ats]}


def walked(capture, start=10, end=100, quota=None, strict=False, retries=2):
    walk = pages.Walk(start, end, quota, strict, retries)
    rows = [r["at"] for page in walk.over(iter(capture)) for r in page]
    return rows, walk.why, walk.pages, walk.strangers, walk.reported


@pytest.mark.parametrize(
    ("capture", "options", "want"),
    [
        # above the window is the approach, below it is the end; the part of the last page inside counts
        ([answer("*", [120, 110], "a", 9), answer("a", [100, 50], "b"), answer("b", [10, 9], "c"), answer("c", [8])], {}, ([100, 50, 10], "below the window", 3, 0, 9)),
        # strict: the first page with a stranger is the last one, and is counted whole
        ([answer("*", [90, 80], "a"), answer("a", [120, 101, 70], "b"), answer("b", [60])], {"strict": True}, ([90, 80, 70], "strangers", 2, 2, None)),
        # a page that fills the quota is cut; below the window goes first
        ([answer("*", [90, 80], "a"), answer("a", [70, 60, 50], "b")], {"quota": 3}, ([90, 80, 70], "quota", 2, 0, None)),
        ([answer("*", [90, 80, 5], "a")], {"quota": 1}, ([90], "below the window", 1, 0, None)),
        # no next cursor, and one that was seen
        ([answer("*", [90])], {}, ([90], "cursor", 1, 0, None)),
        ([answer("*", [90], "a"), answer("a", [80], "*"), answer("*", [70])], {}, ([90, 80], "cursor", 2, 0, None)),
        # two empty answers are asked again, a page between starts anew, the third in a row is the end
        ([answer("*", [90], "a"), answer("a", []), answer("a", []), answer("a", [80], "b"), answer("b", []), answer("b", []), answer("b", []), answer("b", [70])], {}, ([90, 80], "empty pages", 7, 0, None)),
        ([answer("*", [90], "a"), answer("a", [], success=2)], {}, ([90], "no result", 2, 0, None)),
        ([answer("*", [90], "a"), answer("x", [1]), answer("a", [80], "b")], {}, ([90, 80], "no more answers", 2, 0, None)),
        ([], {}, ([], "no more answers", 0, 0, None)),
    ],
)
def test_stops(capture, options, want):
    assert walked(capture, **options) == want


def test_refusals():
    with pytest.raises(ValueError, match="neither 1 nor 2"):
        walked([answer("*", [], success=3)])
    with pytest.raises(ValueError, match="ends before"):
        pages.Walk(5, 4, None, False, 2)
    with pytest.raises(ValueError, match="zone"):
        pages.instant("2020-01-01T00:00:00")


def write(folder, app, name, lines):
    at = folder / f"app_id={app}"
    at.mkdir(parents=True, exist_ok=True)
    (at / name).write_text("\n".join(json.dumps(x) for x in lines) + "\n")


def test_source(spark, tmp_path):
    write(tmp_path, 1, "part-0", [answer("*", [90, 80], "a", 4)])
    write(tmp_path, 1, "part-1", [answer("a", [], None), answer("a", [70, 60])])
    write(tmp_path, 2, "part-0", [answer("*", [5])])
    write(tmp_path, 2, "_SUCCESS", [])
    spark.dataSource.register(pages.ReviewPages)
    source = spark.read.format("review_pages").option("path", str(tmp_path)).option("start", "1970-01-01T00:00:10+00:00").option("end", "1970-01-01T00:01:30+00:00")
    rows = source.load()
    assert sorted((r.app_id, r.page, r.review_id) for r in rows.collect()) == [(1, 0, "r80"), (1, 0, "r90"), (1, 2, "r60"), (1, 2, "r70")]
    assert rows.rdd.getNumPartitions() == 2
    walks = source.option("table", "walks").load()
    assert sorted(map(tuple, walks.collect())) == [(1, 3, 4, 0, 4, False, "cursor"), (2, 1, 0, 0, None, False, "below the window")]
    (tmp_path / "none").mkdir()
    with pytest.raises(PySparkException, match="no pages"):
        source.option("path", str(tmp_path / "none")).load().collect()


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    spark.dataSource.register(pages.NewPages)
    store, where = tmp_path / "store", str(tmp_path / "out")
    for k in range(3):
        write(store, 1, f"part-{k}", [answer("*", [95 - k, 50 - k, 9 - k])])
    options = {"path": str(store), "start": "1970-01-01T00:00:10+00:00", "end": "1970-01-01T00:01:30+00:00", "files": "1", "progress": str(tmp_path / "progress")}
    seen = []
    for k in range(4):  # each run ends, and the next one starts from the checkpoint
        stream = spark.readStream.format("new_review_pages").options(**options).load()
        query = stream.writeStream.format("parquet").option("path", where).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
        query.awaitTermination()
        seen.append(spark.read.schema(stream.schema).parquet(where).count())
        if k == 2:
            write(store, 2, "part-0", [answer("*", [91])])
    assert seen == [3, 6, 9, 10]
    got = spark.read.parquet(where).groupBy("place").count().collect()
    assert {r.place: r["count"] for r in got} == {"above": 4, "in": 3, "below": 3}
    with pytest.raises(PySparkException):
        runs.to_table(spark.readStream.format("new_review_pages").options(**options | {"progress": ""}).load(), where + "x", str(tmp_path / "cx"))


def test_pages_are_handed_on_together(tmp_path):
    n = 1_000
    write(tmp_path, 4, "0.txt", [answer("*" if k == 0 else f"c{k}", [10_000 - 3 * k, 9_999 - 3 * k, 9_998 - 3 * k], f"c{k + 1}") for k in range(n)])
    reader = pages._Reader({"path": str(tmp_path), "start": "1970-01-01T00:00:00+00:00", "end": "1971-01-01T00:00:00+00:00"})
    batches = list(reader.read(reader.partitions()[0]))
    assert len(batches) == 2 and max(map(len, batches)) <= pages.ROWS + 3
    assert [x for b in batches for x in b["page"].to_pylist()] == [k for k in range(n) for _ in range(3)]
    assert [x for b in batches for x in b["review_id"].to_pylist()] == [f"r{10_000 - i}" for i in range(3 * n)]
