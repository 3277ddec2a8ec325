"""Changes that are seen whole or not at all; fixtures that are refused when damaged."""

import json
import os

import pytest
from pyspark.sql import functions as F

from hearsay.sources import store as st


def made(spark, tmp_path, n=40):
    store = st.Store(spark, str(tmp_path / "store"), 4)
    rows = spark.range(n).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"), F.lit(None).cast("string").alias("note"))
    runs = spark.createDataFrame([("r1", "a")], "run string, by string")
    assert store.commit(0, {"rows": (rows, ["k"], None), "runs": (runs, ["run"], None)}) == 1
    return store


def values(store, version=None):
    return {r.k: (r.v, r.note) for r in store.read("rows", version).collect()}


def patch(spark, rows):
    return spark.createDataFrame(rows, "k long, before_v string, after_v string, before_note string, after_note string, drop boolean")


def test_repair_changes_all_or_nothing(spark, tmp_path):
    store = made(spark, tmp_path)
    reader = store.read("rows")  # begins at version 1
    good = [(1, "v1", "w1", None, "x", False), (2, "v2", "w2", None, None, False), (3, "v3", None, None, None, True)]
    assert st.repair(store, {"rows": (patch(spark, good), ["v", "note"])}) == 2
    now = values(store)
    assert now[1] == ("w1", "x") and now[2] == ("w2", None) and 3 not in now and now[4] == ("v4", None) and len(now) == 39
    assert {r.k: r.v for r in reader.collect()} == {k: f"v{k}" for k in range(40)}  # the old version is still whole
    for bad, why in (
        ([(5, "v5", "w5", None, None, False), (1, "v1", "again", "x", None, False)], "moved"), ([(5, "v5", "w5", None, None, False), (99, "v", "w", None, None, False)], "no such row"),
        ([(5, "v5", "w5", None, None, False)] * 2, "twice"), ([(5, "v5", "w5", "not null", None, False)], "moved"),
    ):
        with pytest.raises(ValueError, match=why):
            st.repair(store, {"rows": (patch(spark, bad), ["v", "note"])})
        assert store.head() == 2 and values(store) == now


def test_repair_writes_only_touched_buckets(spark, tmp_path):
    store = made(spark, tmp_path)
    before = store._entry(1)["rows"]["buckets"]
    one = patch(spark, [(7, "v7", "w7", None, None, False)])
    st.repair(store, {"rows": (one, ["v", "note"])})
    after = store._entry(2)["rows"]["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1 and store._entry(2)["runs"] == store._entry(1)["runs"]


def test_second_writer_of_a_version_is_refused(spark, tmp_path):
    store, rows = made(spark, tmp_path), None
    rows = store.read("rows").limit(1)
    assert store.commit(1, {"rows": (rows, ["k"], None)}) == 2
    with pytest.raises(st.Conflict):
        store.commit(1, {"rows": (rows, ["k"], None)})
    assert store.head() == 2 and len(values(store)) == 1
    assert not [f for f in os.listdir(tmp_path / "store" / "_log") if f.startswith(".draft")]


def test_parents_and_children_come_together(spark, tmp_path):
    store = made(spark, tmp_path)
    run = spark.createDataFrame([("r2", "b")], "run string, by string")
    child = lambda k, of: spark.createDataFrame([(k, of, None)], "k long, v string, note string")
    of = {"rows": ("runs", "v")}
    with pytest.raises(ValueError, match="no parent"):
        st.append_together(store, {"runs": run, "rows": child(100, "r3")}, of)
    with pytest.raises(ValueError, match="stored already"):
        st.append_together(store, {"runs": run, "rows": child(5, "r2")}, of)
    assert store.head() == 1 and store.read("runs").count() == 1
    assert st.append_together(store, {"runs": run, "rows": child(100, "r2")}, of) == 2
    assert store.read("runs").count() == 2 and values(store)[100] == ("r2", None)


def fixture(spark, tmp_path, **more):
    a = spark.createDataFrame([(i, f"é\n{i}" if i % 2 else None) for i in range(25)], "k long, text string")
    b = spark.createDataFrame([("x", 1.5)], "name string, value double")
    st.export_fixture({"a": a, "b": b}, str(tmp_path / "f"), {"a": ["k"], "b": ["name"]}, rows_per_file=5, **more)
    return a, b


def test_fixture_round_trip(spark, tmp_path):
    a, b = fixture(spark, tmp_path)
    got = st.load_fixture(spark, str(tmp_path / "f"))
    assert got["a"].dtypes == a.dtypes and sorted(map(tuple, got["a"].collect())) == sorted(map(tuple, a.collect()))
    assert list(map(tuple, got["b"].collect())) == list(map(tuple, b.collect()))
    with pytest.raises(FileExistsError):
        fixture(spark, tmp_path)


def parts(tmp_path):
    at = tmp_path / "f" / json.loads((tmp_path / "f" / "manifest.json").read_text())["data"] / "a"
    return at, sorted(p for p in at.iterdir() if p.name.startswith("part-"))


@pytest.mark.parametrize(("kind", "fault"), [("flip", "its bytes have changed"), ("cut", "its bytes have changed"), ("lose", "lost"), ("add", "not in the manifest")])
def test_damaged_fixture_is_refused(spark, tmp_path, kind, fault):
    fixture(spark, tmp_path)
    at, files = parts(tmp_path)
    assert len(files) >= 5
    one = files[2]
    crc = at / f".{one.name}.crc"
    crc.unlink(missing_ok=True)
    if kind == "flip":
        raw = bytearray(one.read_bytes())
        raw[3] ^= 1
        one.write_bytes(raw)
    elif kind == "cut":
        one.write_bytes(one.read_bytes()[:-4])
    elif kind == "lose":
        one.unlink()
    else:
        (at / "part-extra.txt").write_text('{"k": 1, "text": "more"}\n')
    with pytest.raises(ValueError, match=fault):
        st.load_fixture(spark, str(tmp_path / "f"))


def test_fixture_is_not_written_when_a_pin_moved(spark, tmp_path):
    pin = lambda v: spark.createDataFrame([("f1", v)], "metric string, value double")
    with pytest.raises(ValueError, match="f1"):
        fixture(spark, tmp_path, pins=[("certification", pin(0.5), pin(0.6))])
    assert not (tmp_path / "f").exists()
    fixture(spark, tmp_path, pins=[("certification", pin(0.5), pin(0.5))])
