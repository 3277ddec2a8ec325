import hashlib
import math
import re
from collections import Counter

import xxhash

from hearsay.llm import imatch, queries

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def xx(data, seed=42):
    return xxhash.xxh64(data, seed=seed).intdigest()


def terms(text):
    return {xx(w.encode()) for w in SPACE.split(text.lower()) if w}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def eight(x):
    return (x % (1 << 64)).to_bytes(8, "little")


def cell(term, way, at):
    return xx(way.to_bytes(4, "little"), xx(eight(term))) & ((1 << at) - 1)


def entries(text, band):
    found = terms(text)
    first = max(0, math.floor(math.log2(max(len(found), 1))) - 1)
    at_all = [t for t in found if any(cell(t, w, first) < imatch.CELLS for w in (0, 1))]
    kept = [t for t in at_all if t in band]
    mark = 0 if kept else imatch.UNBANDED
    out = []
    for at in range(first, first + imatch.SCALES):
        for w in (0, 1):
            for c in range(imatch.CELLS):
                mine = sorted(signed(t) for t in kept or at_all if cell(t, w, at) == c)
                h = 0
                for t in mine:
                    h = xx(eight(t), xx(eight(h)))
                if mine:
                    out.append((at + mark) << 24 | (c + w * imatch.CELLS) << 16 | h & 65535)
    return out


def likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    low, high = max(min(a), min(b)) >> 24, min(max(a), max(b)) >> 24
    subsets = {e >> 16 for e in a + b if low <= e >> 24 <= high}
    return len(set(a) & set(b)) / len(subsets) if subsets else 0.0


def brute(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    df = Counter(t for _, text in rows for t in terms(text))
    low, high = max(2.0, len(rows) / imatch.RAREST), max(3.0, len(rows) / imatch.COMMONEST)
    band = {t for t, n in df.items() if low <= n <= high}
    out = []
    for i, (d, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        m = len(text) // 3
        edited = text[: len(text) - m] + after[:m]
        a, b, c = (entries(t, band) for t in (text, edited, after))
        shown = ["".join("%08x" % e for e in x) for x in (a, b)]
        out.append((d, len(text), hashlib.sha256(edited.encode()).hexdigest(), *shown, round(likeness(a, b), 9), round(likeness(a, c), 9)))
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


ODD = [
    (5, None), (4, ""), (9, "  \n"), (100, "one"), (101, "Two words"), (-3, "é ü 日本 \U0001f600 x" * 5), (7, "w " * 3000), (8, "w " * 3000),
    (1000, " ".join("t%d" % (i % 97) for i in range(900))), (1001, " ".join("t%d" % (i % 89) for i in range(900))), (None, "no id"), (4, ""),
]


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(d, t, "x") for d, t in ODD], "doc_id long, text string, fingerprint string").repartition(3)
    assert collected(imatch.compare(docs)) == brute(ODD)
    assert collected(imatch.compare(docs.filter("doc_id = 9"))) == brute([(9, "  \n")])
    assert imatch.compare(docs.limit(0)).collect() == []


def test_order_over_many_ranges(spark):
    rows = [(i * i % 1013, "a%d b" % i) for i in range(400)]
    rows = list(dict(rows).items())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in imatch.with_next(docs, rows_at_once=2, splits=7).collect()}
    ordered = sorted(rows, reverse=True)
    assert got == {d: ordered[(i + 1) % len(ordered)][1] for i, (d, _) in enumerate(ordered)}


def test_query_on_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in queries.read(spark, sf_dir, "documents").collect()]
    df = queries.op1_imatch(spark, sf_dir)
    assert collected(df) == brute(rows)
    found = df.toPandas()
    assert (found.near_edited > found.near_next).mean() > 0.9


def test_texts_without_a_term_in_the_band_are_told_apart(spark):
    rare = [" ".join("r%d_%d" % (d, i) for i in range(60)) for d in range(2)]  # each term in one text only
    rows = [(0, rare[0]), (1, rare[1]), (3, None)] + [(10 + i, "u%d v%d" % (i, i)) for i in range(4)]
    got = {r.doc_id: r for r in imatch.compare(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].near_next == 0.0 and 0.0 < got[1].near_edited < 1.0
    usual = [" ".join("z%d" % ((i + j) % 60) for i in range(40)) for j in (0, 0, 30, 9)]  # in too many texts
    got = {r.doc_id: r for r in imatch.compare(spark.createDataFrame(list(enumerate(usual)), "doc_id long, text string")).collect()}
    assert got[1].near_next == 1.0 and got[3].near_next < 0.7


def test_very_long_texts_share_what_they_share(spark):
    words = ["l%d" % i for i in range(60_000)]
    rows = [(0, " ".join(words[:50_000])), (1, " ".join(words[2000:52_000]))] + [(2 + i, "l%d" % i) for i in range(3)]
    got = {r.doc_id: r for r in imatch.compare(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].near_next > 0.6 and len(got[0].fingerprint) <= 8 * imatch.SCALES * 2 * imatch.CELLS
