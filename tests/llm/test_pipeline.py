import re

import corpus_pipeline as pipeline
import pytest

from hearsay.llm import jaccard, mixing, queries, toxicity
from tests.llm.test_jaccard import brute as components
from tests.llm.test_mixing import plain_targets
from tests.llm.test_substrings import brute as passages

tokenizers = pytest.importorskip("tokenizers")
SF = "/root/testdata/sf0.001"


def test_each_stage_on_what_its_predecessor_kept(spark, tmp_path):
    docs = queries.read(spark, SF, "documents")
    columns = docs.columns
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "mixing", "bpe"]
    before, kept = None, docs
    outs = []
    for name, stage in pipeline.STAGES:
        out = stage(spark, kept, SF)
        out.write.parquet(str(tmp_path / name))
        before, kept = kept, spark.read.parquet(str(tmp_path / name))
        outs.append((before.collect(), kept.collect()))
        if name != "bpe":
            assert kept.columns == columns

    # toxicity
    labels = queries.read(spark, SF, "labels").filter(~toxicity.held_out())
    predicted = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert {r.doc_id for r in outs[0][1]} == {d for d, p in predicted.items() if p == 0}
    # near duplicates
    rows = [(r.doc_id, r.text) for r in outs[1][0]]
    assert {r.doc_id for r in outs[1][1]} == {c for _, _, c in components(rows)}
    # passages
    texts = {r.doc_id: r.text for r in outs[2][0]}
    want = {d: (k if g else texts[d]) for d, _, g, k in passages(list(texts.items()), 35)}
    assert {r.doc_id: r.text for r in outs[2][1]} == want
    assert all(r.n_chars == len(r.text) for r in outs[2][1] if r.text != texts[r.doc_id])
    # mixing
    sizes, taken = {}, {}
    words = lambda t: len(re.findall(mixing.WORD, t or ""))
    for r in outs[3][0]:
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
    for r in outs[3][1]:
        taken[r.source] = taken.get(r.source, 0) + words(r.text)
    largest = max(words(r.text) for r in outs[3][0])
    for s, t in plain_targets(sizes).items():
        assert abs(taken.get(s, 0) - t) <= largest
    # token ids
    library = tokenizers.Tokenizer.from_file(f"{queries.TOKENIZERS}/word_bpe_49k.json")
    mixed = sorted((r.doc_id, r.text) for r in outs[4][0])
    got = sorted((r.doc_id, list(r.ids), r.decoded, r.n_tokens) for r in outs[4][1])
    assert len(mixed) == len(got)
    for (d, text), (e, ids, decoded, n) in zip(mixed, got, strict=True):
        assert d == e and n == len(ids)
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert decoded == library.decode(ids, skip_special_tokens=False)


def test_stages_take_odd_rows(spark):
    rows = [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (2, "A B c d e f g", "en", None, 13), (3, None, None, None, None), (4, "", "en", "s", 0)]
    rows += [(None, "x y z", "en", "s", 5), (None, "no id either", "en", "t", 12), (5, "long " * 30_000, "en", "t", 150_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = jaccard.one_of_each(docs).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in kept) == sorted([("1", rows[0][1]), ("3", ""), ("4", ""), ("None", "x y z"), ("None", "no id either"), ("5", "long " * 30_000)])
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs.collect()
    for _, stage in pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"), SF).collect() == []
