import hashlib
import zlib

import duckdb
import pytest

from hearsay.llm import merkle, oracle, queries
from verify_queries import plain

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, lower=False):
    text = r["text"]
    if lower and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(digests):
    """All levels of a tree."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        first = at // 8 * 8
        out += [d for i, d in enumerate(level[first : first + 8], first) if i != at]
        at //= 8
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[g] = climb([leaf(r) for r in groups[g]])
    top = climb([trees[g][-1][0] for g in order])
    out = []
    for i, g in enumerate(order):
        for k, r in enumerate(groups[g]):
            proof = siblings(trees[g], k) + siblings(top, i)
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and leaf(r, True) != leaf(r)
            out.append((r["doc_id"], leaf(r), trees[g][-1][0], top[-1][0], h(*proof), not tampered))
    return sorted(out, key=str)


def table(spark, rows, tmp_path):
    spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    return [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in queries.op11_merkle(spark, str(tmp_path)).collect()]


def doc(i, lang="en", text="Some Text", **more):
    return {"doc_id": i, "text": text, "lang": lang, "source": "s", "n_chars": len(text or "")} | more


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 520])
def test_tree_of_one_group(spark, tmp_path, n):
    rows = [doc(i, text=f"Text {i}") for i in range(n)]
    assert sorted(table(spark, rows, tmp_path), key=str) == brute(rows)


def test_odd_rows_and_many_groups(spark, tmp_path):
    rows = [doc(i, lang=f"l{i % 70}") for i in range(150)] + [doc(i, lang=g) for i, g in enumerate([None, "", "-", "é", "\U0001f600"] * 3)]
    rows += [doc(None, text="x"), doc(None, text="y"), doc(5, text=None, source=None, n_chars=None), doc(5, text=""), doc(5, text="A" * 300_000), doc(-7)]
    rows += [doc(11, text="same")] * 20  # equal rows
    assert sorted(table(spark, rows, tmp_path), key=str) == brute(rows)


def test_empty_table(spark, tmp_path):
    assert table(spark, [], tmp_path) == []


def test_proofs_carry_columns_and_fold(spark):
    rows = spark.createDataFrame([(i, "g", "body", f"digest{i}", "mine") for i in range(100)], "k long, tree string, path string, digest string, n string")
    from pyspark.sql import functions as F

    made = merkle.build(rows, merkle.leaf("k", "n"), "tree", ["k"], {"kept": F.col("n")})
    root = made.root().first().root
    found = made.proofs().withColumn("folded", merkle.fold(F.col("digest"), F.col("path"))).collect()
    assert len(found) == 100 and all(r.folded == root == r.root and r.kept == "mine" and len(r.path) == 3 for r in found)


def test_query_beside_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = queries.op11_merkle(spark, SF)
    cursor = db.execute(oracle.MERKLE)
    names = [d[0] for d in cursor.description]
    assert sorted(tuple(plain(r[c]) for c in names) for r in df.collect()) == sorted(tuple(map(plain, r)) for r in cursor.fetchall())


def test_no_python_workers(spark):
    plan = queries.op11_merkle(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan
