import hashlib

import pytest

tokenizers = pytest.importorskip("tokenizers")
from pyspark.sql import functions as F  # noqa: E402

from hearsay.llm import bpe, queries  # noqa: E402

PATH = f"{queries.TOKENIZERS}/word_bpe_49k.json"
ODD = [
    "", "   \n", None, "a  b", "x  y", "It's  <|endoftext|> ok, \n\nB.\nC", "ΟΔΥΣΣΕΥΣ Σ ΑΣ. É é ﬁ ß İ", "a.b,c;d!e?f:g",
    "\x1c\x1d x\x85y z 　", "日本語 テキスト 123 45.6", "<|startoftext|><|endoftext|>x<|endoftext|> y", "don't we'LL THEY'RE 's", " lead",
    "trail ", "\n", "a\n", "\na", "...!? .a,", "̸ ≮ .̸a ,̸", "word " * 30_000, "x" * 5_000, "same", "same",
]


def test_ids_and_text_are_the_librarys(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, decoded string")
    encoded = bpe.encode(docs, PATH)
    assert encoded.columns == ["doc_id", "decoded", "ids"]
    rows = {r.doc_id: r for r in bpe.decode(encoded, PATH).collect()}
    library = tokenizers.Tokenizer.from_file(PATH)
    for i, text in enumerate(ODD):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert list(rows[i].ids) == want, repr(text)[:60]
        assert rows[i].decoded == library.decode(want, skip_special_tokens=False)


def test_query_on_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op9_bpe(spark, sf_dir).collect()}
    docs = queries.read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    library = tokenizers.Tokenizer.from_file(PATH)
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text, add_special_tokens=False).ids
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(docs, PATH), PATH).collect() == []
