import pathlib
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from hearsay.llm import components, jaccard, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, size=5):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) or frozenset([tuple(words)])


def brute(rows, size=5):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)):
                inter = len(a & b)
                if 100 * inter >= 75 * (len(a) + len(b) - inter):
                    parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def operator(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, component_id int").repartition(3)
    return sorted(tuple(r) for r in jaccard.link(docs, **options).select("doc_id", "n_shingles", "component_id").collect())


def near_copies():
    rng = random.Random(3)
    words = ["w%d" % i for i in range(3000)]
    passage = [rng.choice(words) for _ in range(50)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([4, 30, 80, 200]))]
        for _ in range(rng.choice([1, 2, 3, 25])):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(text) // 25))):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.3:
                text += passage
            rows.append(" ".join(text))
    rows += [rows[0].upper(), rows[0] + "\n", "", None, "  \t", "one", "One", "two words", "two  words", "a " * 400, "a " * 20]
    rng.shuffle(rows)
    return list(enumerate(rows)) + [(7, rows[7])]


@pytest.mark.parametrize(("chunk", "tries", "frequent"), [(1024, 16, 100_000), (3, 1, 100_000), (4, 2, 5)])
def test_components_against_all_pairs(spark, chunk, tries, frequent):
    rows = near_copies()
    assert operator(spark, rows, chunk=chunk, tries=tries, frequent=frequent) == brute(rows)


def test_no_link_between_chunks_is_lost(spark):
    """A chain of near copies, each like its neighbours only, in chunks of three."""
    words = ["v%d" % i for i in range(400)]
    rows = [(i, " ".join(words[6 * i : 6 * i + 80])) for i in range(40)] + [(100 + i, " ".join(words[6 * i : 6 * i + 79])) for i in range(0, 40, 3)]
    assert operator(spark, rows, chunk=3) == brute(rows)


def test_query_on_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in queries.read(spark, sf_dir, "documents").collect()]
    got = sorted(tuple(r) for r in queries.op2_jaccard(spark, sf_dir).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute(rows)


def test_tree_never_drops_a_link():
    rng = np.random.default_rng(1)
    pool = [np.unique(rng.integers(0, 1 << 40, k).astype(np.uint64)) for k in rng.integers(1, 400, 12)]
    sets = []
    for s in pool:
        sets.append(s)
        for _ in range(30):
            keep = s[rng.random(len(s)) > rng.random() * 0.3]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 40, rng.integers(0, len(s) // 8 + 1)).astype(np.uint64)])))
    sets = [s for s in sets if len(s)]
    found = jaccard.points(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    tree = jaccard.Tree(found, Fraction(3, 4), fan=4)
    assert len(tree.levels) > 3
    looked = linked = 0
    for s, p in zip(sets, found, strict=True):
        fine = jaccard._occurrences(p)
        at = {j for j in tree.search(p).tolist() if tree.spare(fine, j) >= 0}
        looked += len(at)
        for j, other in enumerate(sets):
            inter = len(np.intersect1d(s, other))
            if 4 * inter >= 3 * (len(s) + len(other) - inter):
                linked += 1
                assert j in at
    assert linked <= looked < linked * 1.1


def test_one_shingle_in_thousands_of_classes(spark):
    """A passage that all documents begin with, a large group of near copies of it, and own endings."""
    rng = random.Random(5)
    passage = ["p%d" % i for i in range(60)]
    rows = []
    for i in range(2500):
        own = ["o%d" % rng.randrange(10**6) for _ in range(5 if i % 5 == 0 else 40)]
        rows.append((i, " ".join(passage + own)))
    got = operator(spark, rows, chunk=64)
    assert [r[2] for r in got] == [0 if i % 5 == 0 else i for i in range(2500)]


def test_private_names_do_not_clash(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 5, 6), (2, "a b c d e f", 7, 8), (3, None, 9, 9)], "doc_id long, text string, _key long, root long")
    assert sorted(tuple(r) for r in jaccard.one_of_each(docs).select("doc_id", "_key", "root").collect()) == [(1, 5, 6), (3, 9, 9)]


def test_empty_table(spark):
    assert operator(spark, []) == []


def test_connected_components(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(50, 40), (40, 60), (70, 70), (81, 80), (80, 81)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys((40, 50, 60), 40), 80: 80, 81: 80}


def test_only_what_can_be_linked_meets(spark, monkeypatch):
    """Texts that share a passage but whose sizes no link allows do not meet, and what was written for the join is deleted."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    rows = [(k, " ".join(passage + [f"w{rng.random()}" for _ in range(90 * 2**k)])) for k in range(4)]
    rows += [(10 + k, " ".join([f"q{i}" for i in range(80)] + ["x"] * k)) for k in range(3)]
    seen = {}
    written = jaccard.shared.written
    dropped = jaccard.shared.dropped

    def counted(df, name):
        seen[name] = written(df, name)
        if name == "met":
            seen["classes"] = {r["n"] for r in seen[name].select("n").distinct().collect()}
        return seen[name]

    def gone(*tables):
        seen["gone"] = len(tables)
        files = [f.removeprefix("file:") for t in tables for f in t.inputFiles()]
        dropped(*tables)
        assert files and not any(pathlib.Path(re.sub("^/+", "/", f)).exists() for f in files)

    monkeypatch.setattr(jaccard.shared, "written", counted)
    monkeypatch.setattr(jaccard.shared, "dropped", gone)
    found = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, found.collect())) == brute(rows)
    assert seen["classes"] <= {len(shingles(t)) for d, t in rows if d >= 10} and seen["classes"]
    assert seen["gone"] == 2


def test_rows_that_pass_a_table_of_bits(spark):
    rows = [(k * 0x9E3779B97F4A7C15 + 2**63) % 2**64 - 2**63 for k in range(5000)]
    df = spark.createDataFrame([(k, str(k)) for k in rows], "key long, text string")
    keys = df.filter("key % 50 = 0").select("key")
    wanted = {r["key"] for r in keys.collect()}
    passed = [r["key"] for r in jaccard.shared.likely(df, "key", keys).collect()]
    assert wanted <= set(passed) and len(passed) < 5 * len(wanted) + 200
    assert jaccard.shared.likely(df, "key", keys.limit(0)).count() == 0
    assert jaccard.shared.likely(df, "key", df.select("key"), most_bits=64).count() == 5000
