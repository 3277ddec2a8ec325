import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearsay.llm import queries, toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", min_size=5, max_size=8), min_size=1, max_size=5), st.text("abc", min_size=3, max_size=9), st.integers(1, 2))
def test_automaton_is_edit_distance(terms, word, edits):
    lexicon = toxicity.Lexicon({t: 1.0 for t in terms}, edits=edits)
    assert bool(lexicon.near(word)) == any(distance(word, t) <= edits for t in terms)


def test_tokens():
    lexicon = toxicity.Lexicon({"idiot": 3.0, "grob*": 2.0, "grobian": 1.0})
    name = lambda text: lexicon.terms[lexicon.token(text)[0] - 1] if lexicon.token(text)[0] else None
    assert name("Idiot,") == "idiot" and lexicon.token("Idiot,")[1] == 0
    assert name("id1ot!") == "idiot" and lexicon.token("id1ot!")[1] == 1
    assert name("grobheit") == "grob*" and name("grobian") == "grob*"
    assert name("robot") is None and name("") is None and name("123") is None
    assert lexicon.token('"idiot"')[1] == 2


def test_families_of_words_are_still_looked_up_misspelled():
    counts = {"stupid": (60.0, 0.0), "stupidly": (20.0, 0.0), "stupidity": (20.0, 0.0), "oaf": (9.0, 0.0)}
    counts |= {"stupid"[:k] + "*": (100.0, 0.0) for k in (4, 5, 6)}
    chosen = toxicity.choose_terms(counts, 1000.0, 1000.0, 4000)  # of 1000 toxic texts 4 are enough
    assert {"stupid", "stupidly", "stupidity", "oaf"} <= set(chosen)
    lexicon = toxicity.Lexicon(chosen)
    for word, how in (("stupidest", 0), ("stpid", 1), ("stvpid", 1), ("stvpidly", 1)):
        term, found = lexicon.token(word)
        assert term and found == how, word


def corpus(n=600):
    rng = random.Random(1)
    words = ["wo%d%s" % (i, "abc"[i % 3] * 2) for i in range(400)]
    rows = []
    for i in range(n):
        text, toxic = [rng.choice(words) for _ in range(rng.randint(5, 60))], rng.random() < 0.25
        for _ in range(3 if toxic else 0):
            bad = rng.choice(["vermin", "rotten", "schuft" + rng.choice("aeiou") * 2])
            if rng.random() < 0.1:
                bad = bad[:3] + "x" + bad[4:]
            text.insert(rng.randrange(len(text)), bad)
        rows.append((i, " ".join(text), int(toxic)))
    return rows


@pytest.mark.parametrize("flip", [0, 1])
def test_regression_finds_its_optimum_where_whole_newton_steps_swing(flip):
    heaviest = np.repeat([4.0, 6.0], [1206, 180])  # as of clean and toxic texts, and the other way round
    x, y = np.stack([np.ones_like(heaviest), heaviest], axis=1), np.abs((heaviest > 5) - flip)
    w = toxicity.fit_regression(x, y)
    assert ((x @ w > 0) == y).all()
    assert x.T @ (y - 1 / (1 + np.exp(-x @ w))) - [1e-3, 1.0] * w == pytest.approx(0, abs=1e-6)


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0.0) for i, t, _ in rows] + [(None, None, 0.0), (9999, "", 0.0), (9998, "x " * 20_000, 0.0), (3, rows[3][1], 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, 0), (77777, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out()))
    assert any(t.startswith("schuf") and t.endswith("*") for t in model.weights)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {i: y for i, _, y in rows}
    tested = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.predicted == truth[r.doc_id] for r in tested]) > 0.95
    assert all(r.predicted == 0 for r in got if r.doc_id in (9999, 9998))


def test_different_long_texts_are_no_copies_and_copies_count_once(spark):
    rng = random.Random(4)
    common = ["c%s" % (chr(97 + i % 26) * 3 + chr(97 + i // 26)) for i in range(60)]  # every text has all of them
    text = lambda *more: " ".join(rng.sample([*common, *more], 60 + len(more)))
    other = [text("fine" + chr(97 + i % 26) + chr(97 + i // 26)) for i in range(200)]
    rare = [text("scoundrel", "own" + chr(97 + i)) for i in range(10)]
    copies = [text("copied", "ruffian")] * 90 + [" ".join(reversed(text("copied", "ruffian").split()))] * 10
    rows = [(i, t, int(i >= len(other))) for i, t in enumerate(other + rare + copies)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert "scoundrel" in model.weights and "ruffian" not in model.weights
    assert not {w for w in common} & set(model.weights)
    assert [r.predicted for r in toxicity.score(spark.createDataFrame([(text("scoundrel"),), (text("fine"),)], "text string"), model).collect()] == [1, 0]


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, none)).first().predicted == 0
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, none)).collect() == []


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01"])
def test_query_on_whole_table(spark, sf_dir):
    got = queries.op5_toxicity(spark, sf_dir)
    truth = queries.read(spark, sf_dir, "labels").select("doc_id", "toxic")
    rows = got.join(truth, "doc_id").filter("held_out").collect()
    assert got.count() == queries.read(spark, sf_dir, "documents").count()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.9
    wrong = got.filter(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)).count()
    assert wrong == 0


def brute(text, model):
    """The score of a text from all its words beside all terms, by edit distance."""
    weights, marks_ = model.weights, "\"“”„«»‹›‘’'`"
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    hits = []
    quotes = [w[0] in marks_ or w.rstrip(".,;:!?)")[-1:] in tuple(marks_) for w in words]
    for i, w in enumerate(words):
        low = w.lower()
        parts = re.findall(r"[^\W\d_]+", low)
        exact = [weights[t] for t in weights for p in parts if p == t or t.endswith("*") and p.startswith(t[:-1])]
        core = low.strip("\"“”„«»‹›‘’'`.,;:!?()[]{}<>-|")
        tried = {core, *parts} - model.ordinary if re.search(r"[^\W\d_]", core) else set()
        near = [weights[t] for t in weights for p in tried if not t.endswith("*") and len(t) >= 5 and 4 <= len(p) <= 40 and distance(p, t) <= 1]
        if exact or near:
            before, after = any(quotes[max(0, i - 3) : i]), any(quotes[i + 1 : i + 4])
            found = max(exact or near)
            terms = [t for t in weights if weights[t] == found]
            hits.append((found, not exact, before and after or quotes[i], terms))
    said = [h for h in hits if not h[2]]
    x = [
        1, math.log1p(sum(h[0] for h in said if not h[1])), math.log1p(sum(h[0] for h in said if h[1])), math.log1p(sum(h[0] for h in hits if h[2])),
        max((h[0] for h in said), default=0), math.log1p(len({h[0] for h in said})), min(1.0, sum(h[0] for h in said) / max(1, len(words)) * 10), math.log1p(len(words)),
    ]
    return 1 / (1 + math.exp(-float(np.dot(x, model.regression))))


def test_misspelt_terms_raise_scores_quoted_ones_do_not_and_all_scores_are_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    # terms of one weight are one kind to the brute force, so each gets a weight of its own
    model.weights = {t: w + k * 1e-6 for k, (t, w) in enumerate(sorted(model.weights.items()))}
    lexicon = toxicity.Lexicon(model.weights, ordinary=model.ordinary)
    clean = " ".join("wo%dcc" % i for i in range(30))
    texts = [clean + " vermin " + clean + " rotten", clean + " vrmin " + clean + " rxtten", clean + ' "vermin" ' + clean + " 'rotten'", clean + " he said \"you're vermin to me\" " + clean, clean, ""]
    texts += [t for _, t, _ in rows[:150]] + [m for _, t, y in rows[:150] if y for m in toxicity.planted(t, lexicon)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(frame, model).collect()}
    assert got == pytest.approx({i: brute(t, model) for i, t in enumerate(texts)}, abs=1e-9)
    assert got[0] > 0.5 and got[1] > 0.5 and max(got[k] for k in (2, 3, 4, 5)) < 0.5
    # without the automaton's hits the misspelt text is clean, and without its marks the quoting one is not
    exact_only = toxicity.Model(model.weights, model.regression, model.ordinary | {"vrmin", "rxtten"})
    assert brute(texts[1], exact_only) < 0.5 < brute(texts[2].replace('"', "").replace("'", ""), model)


def test_ordinary_words_near_a_term_are_no_hits(spark):
    rng = random.Random(2)
    text = lambda *more: " ".join([*rng.sample(["c%s" % (chr(97 + i) * 4) for i in range(26)], 12), *more])
    rows = [(i, text("rotter" if i % 2 else "cotten"), 0) for i in range(300)] + [(300 + i, text("rotten"), 1) for i in range(80)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert {"rotter", "cotten"} <= model.ordinary and "rotten" in model.weights
    texts = [(text("rotter"),), (text("rotten"),), (text("rottxn"),)]
    assert [r.predicted for r in toxicity.score(spark.createDataFrame(texts, "text string"), model).collect()] == [0, 1, 1]
