import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tokenizers = pytest.importorskip("tokenizers")

from hearsay.llm import grammar, queries  # noqa: E402

PATH = f"{queries.TOKENIZERS}/byte_bpe_50k.json"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=40), min_size=1, max_size=6))
def test_compress_and_expand_are_exact(docs):
    docs = [d + [2] for d in docs]
    ids = np.array([i for d in docs for i in d], np.int64)
    ends = np.cumsum([len(d) for d in docs])
    seq, (left, right), sizes = grammar.compress(ids, ends, 5, 2)
    assert grammar.expand(seq, left, right, 5).tolist() == ids.tolist() == grammar.expand_all(seq, left, right, 5).tolist()
    pairs = [p for d in np.split(seq, np.cumsum(sizes)[:-1]) for p in zip(d[:-1].tolist(), d[1:].tolist(), strict=True)]
    apart = {p: sum(1 for i, q in enumerate(pairs) if q == p) for p in set(pairs)}
    assert all(n < 2 or p[0] == p[1] for p, n in apart.items())  # nothing is frequent any more, but for runs that overlap
    assert len(sizes) == len(docs) and sizes.sum() == len(seq)
    lengths = grammar.rule_lengths(left, right, 5)
    row = {
        "base": 5, "rule_left": left.astype("<u4").tobytes(), "rule_right": right.astype("<u4").tobytes(),
        "rule_length": lengths.astype("<u8").tobytes(), "symbols": seq.astype("<u4").tobytes(), "doc_symbols": sizes,
    }
    shard = grammar.Shard(row)
    for k, d in enumerate(docs):
        assert shard.document(k).tolist() == d
    for a in range(0, len(ids), 7):
        for b in range(a + 1, len(ids) + 1, 5):
            assert shard.tokens(a, b).tolist() == ids[a:b].tolist()


def expected(rows):
    library = tokenizers.Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


ODD = [
    (5, None), (3, ""), (9, "x  y\n\n z.\nA b"), (1, "<|endoftext|> hm <|endoftext|>"), (7, "a b c " * 20_000), (8, "a b c"), (11, "  \t \n"),
    (12, "don't, we'LL! ok?\nNo. 　x y"), (13, "日本語 テキスト ééé"), (None, "no id"), (20, "trail \n"),
]


def test_files_hold_every_document_in_order(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, 1) for i, t in ODD], "doc_id long, text string, ids int")
    shards = grammar.pack(docs, PATH, partitions=3, shard_tokens=1000)
    grammar.write(shards, str(tmp_path / "files"))
    got = grammar.unpack(spark, str(tmp_path / "files")).collect()
    got = sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in got), key=lambda r: r[1])
    assert got == expected(ODD)
    assert spark.read.parquet(str(tmp_path / "files")).agg({"n_rules": "sum"}).first()[0] > 0


def test_query_on_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in queries.op3_token_files(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == expected([(r.doc_id, r.text) for r in queries.read(spark, sf_dir, "documents").collect()])


def test_empty_table(spark, tmp_path):
    grammar.write(grammar.pack(spark.createDataFrame([], "doc_id long, text string"), PATH), str(tmp_path / "none"))
    assert grammar.unpack(spark, str(tmp_path / "none")).collect() == []
