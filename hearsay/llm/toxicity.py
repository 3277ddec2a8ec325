"""Toxicity scores from a learnt lexicon (operator 5).

Method: a lexicon of terms (whole words, and stems for words that begin with them) is held in a trie. A word that is
not in it is looked up by a Levenshtein automaton that runs along the trie: its states are how much of the word is read
and how many edits are left, so misspelled terms are found without listing their variants. Hits are then read in their
context: a window of words around a hit that holds quotation marks on it counts as quotation, not as abuse. A logistic
regression turns the sums of hits into a score.

Most words an edit away from a term are words of their own. Those that toxic texts don't have more often than others are
ordinary and are no hits, so that what is left of near hits is misspellings. Labelled texts hold few misspellings and
quotations of terms, so the regression is also fitted on planted ones: each toxic text of the sample once with its terms
misspelt by a letter, which is still toxic, and once with its terms in quotation marks, which is not.

Everything is learnt from labelled rows. Terms are those that toxic texts have far more often than others; texts of a
class with the same set of words count once for it, as copies. Terms and
regression are fitted on a bounded sample (``fit_rows`` labelled rows of smallest hash); the regression's features of
each half of it come from terms of the other half, so it is not fitted to hits that the choice of terms has made. The
model is broadcast (``most_terms`` terms at most) and scores every whole text where it is read, without a shuffle.

Edge cases: null and empty texts have no hits and still get a score; without any label of a class the score is that
share of labels, smoothed; several labels of a document count as toxic if one is; labels without a document are not
used; extra columns are kept; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearsay.llm import kernels, shared

#: Shortest and longest stems that are tried as terms.
STEMS = range(4, 10)
#: Words around a hit in which quotation marks count.
WINDOW = 3
_PARTS = re.compile(r"[^\W\d_]+")
_MARKS = "\"“”„«»‹›‘’'`.,;:!?()[]{}<>-|"
_QUOTES = set("\"“”„«»‹›‘’'`")


def terms_of(words: set[str]) -> set[str]:
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) >= k}


class Lexicon:
    """Terms with weights, in a trie; terms that end with * are stems."""

    def __init__(self, weights: dict[str, float], edits: int = 1, fuzzy_from: int = 5, ordinary: frozenset[str] = frozenset()):
        self.terms = sorted(weights)
        self.weights = np.array([0.0, *(weights[t] for t in self.terms)])
        self.edits, self.fuzzy_from, self.ordinary = edits, fuzzy_from, ordinary
        self.root: dict = {}
        self.whole: dict = {}  # of the words that misspellings are looked up in, and of the same read backwards
        self.back: dict = {}
        for i, term in enumerate(self.terms, 1):
            stem = term.endswith("*")
            bare = term.rstrip("*")
            roots = [(self.root, bare)]
            if not stem and len(term) >= fuzzy_from:
                roots += [(self.whole, bare), (self.back, bare[::-1])]
            for node, letters in roots:
                for c in letters:
                    node = node.setdefault(c, {})
                node["stem" if stem else ""] = i

    def exact(self, word: str) -> int:
        """The heaviest term that a word is or begins with; 0: none."""
        node, best = self.root, 0
        for c in word:
            node = node.get(c)
            if node is None:
                return best
            i = node.get("stem", 0)
            if i and self.weights[i] > self.weights[best]:
                best = i
        i = node.get("", 0)
        return i if i and self.weights[i] >= self.weights[best] else best

    def near(self, word: str) -> int:
        """The heaviest whole-word term within the edit distance; 0: none."""
        if self.edits != 1:
            return self._run(self.whole, word, 0, 0)
        # one edit leaves the first or the last half of a term as it is, and a term has a letter less than the word at least
        half = max(0, (len(word) - 1) // 2)
        return self._run(self.back, word[::-1], half, self._run(self.whole, word, half, 0))

    def _run(self, node: dict, word: str, known: int, best: int) -> int:
        """The heavier of best and the terms under node whose first ``known`` letters are the word's, by the automaton."""
        for c in word[:known]:
            node = node.get(c)
            if node is None:
                return best
        seen = set()
        stack = [(node, known, self.edits)]
        n = len(word)
        while stack:
            node, i, left = stack.pop()
            if (id(node), i, left) in seen:
                continue
            seen.add((id(node), i, left))
            end = node.get("", 0)
            if end and n - i <= left and self.weights[end] > self.weights[best]:
                best = end
            if i < n:
                child = node.get(word[i])
                if child is not None:
                    stack.append((child, i + 1, left))
            if left:
                if i < n:
                    stack.append((node, i + 1, left - 1))  # a letter too many
                for c, child in node.items():
                    if len(c) == 1:
                        stack.append((child, i, left - 1))  # a letter missing
                        if i < n and c != word[i]:
                            stack.append((child, i + 1, left - 1))  # another letter
        return best

    def token(self, text: str) -> list[int]:
        """[term, how]: how is 0 for exact, 1 for near; and 2 is added for a quotation mark at either end."""
        low = text.lower()
        marks = 2 if low and (low[0] in _QUOTES or low.rstrip(".,;:!?)")[-1:] in _QUOTES) else 0
        parts = _PARTS.findall(low)
        best = max((self.exact(p) for p in parts), key=lambda i: self.weights[i], default=0)
        if best:
            return [best, marks]
        core = low.strip(_MARKS)
        tried = {core, *parts} - self.ordinary if any(c.isalpha() for c in core) else set()
        best = max((self.near(p) for p in tried if self.fuzzy_from - self.edits <= len(p) <= 40), key=lambda i: self.weights[i], default=0)
        return [best, marks + 1]

    def tokens(self, spans: list[bytes]) -> list[list[int]]:
        return [self.token(s.decode("utf-8", "replace")) for s in spans]


N_FEATURES = 8


def features(lexicon: Lexicon, cache: kernels.IdCache, run: kernels.Run) -> np.ndarray:
    """One row per text: 1; sums of exact, near and quoted weights; of hits that aren't quoted: heaviest, kinds of terms, density;
    length."""
    starts, ends, bounds, _ = kernels.words(run)
    out = np.zeros((len(run), N_FEATURES))
    out[:, 0] = 1
    n = np.diff(bounds)
    out[:, 7] = np.log1p(n)
    flat, _ = cache.ids(run, (starts, ends, bounds))
    if not len(flat):
        return out
    term, how = flat[0::2], flat[1::2]
    marks = np.concatenate([[0], np.cumsum(how >= 2)])
    hits = np.flatnonzero(term)
    docs = np.searchsorted(bounds, hits, "right") - 1
    low, high = np.maximum(hits - WINDOW, bounds[docs]), np.minimum(hits + WINDOW + 1, bounds[docs + 1])
    quoted = (marks[hits] > marks[low]) & (marks[high] > marks[hits + 1]) | (how[hits] >= 2)
    weight, near = lexicon.weights[term[hits]], how[hits] % 2 == 1

    def total(mask: np.ndarray) -> np.ndarray:
        return np.bincount(docs[mask], weight[mask], minlength=len(run))

    out[:, 1], out[:, 2], out[:, 3] = (np.log1p(total(m)) for m in (~quoted & ~near, ~quoted & near, quoted))
    np.maximum.at(out[:, 4], docs[~quoted], weight[~quoted])
    kinds = np.unique(np.stack([docs[~quoted], term[hits][~quoted]]), axis=1)[0]
    out[:, 5] = np.log1p(np.bincount(kinds, minlength=len(run)))
    out[:, 6] = np.minimum(1.0, total(~quoted) / np.maximum(n, 1) * 10)
    return out


def fit_regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 200) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the first column is hardly shrunk. A step is halved until it lessens
    the loss, as whole ones may swing from all texts toxic to none."""
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[0] = 1e-3

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return np.logaddexp(0, z).sum() - y @ z + (shrink * w * w).sum() / 2

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - shrink * w
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(shrink), gradient)
        slope = gradient @ step  # twice what a whole step lessens the loss by, near the end
        if slope < 1e-9:
            return w + step
        part = 1.0
        while (then := loss(w + part * step)) > now - 1e-4 * part * slope:
            part /= 2
            if part < 1e-12:  # the loss is as small as can be told
                return w
        w, now = w + part * step, then
    return w


def choose_terms(counts: dict[str, tuple[float, float]], toxic: float, other: float, most: int, lift: float = 8.0) -> dict[str, float]:
    """Weights of the terms that toxic texts have far more often. counts: term -> texts of each class that have it."""
    least = max(3.0, 0.004 * toxic)
    found = {}
    for term, (n1, n0) in counts.items():
        ratio = ((n1 + 0.5) / (toxic + 1)) / ((n0 + 1.0) / (other + 2))
        if n1 >= least and ratio >= lift:
            found[term] = min(6.0, math.log(ratio))
    best = sorted(found, key=lambda t: (-counts[t][0] * found[t], t))[:most]
    return {t: found[t] for t in best}


def misspelt(word: str) -> str:
    """word with one edit at a place that its hash tells: a letter less, another or one more; never the first."""
    h = zlib.crc32(word.encode("utf-8", "replace"))
    letters = [i for i, c in enumerate(word) if c.isalpha()][1:]
    if not letters:
        return word
    i, other = letters[h % len(letters)], "qxzvkjwy"[h // 64 % 8]
    return word[:i] + ("", other, other + word[i])[h // 4096 % 3] + word[i + 1 :]


def planted(text: str, lexicon: Lexicon) -> tuple[str, str]:
    """A text with its terms misspelt, and with its terms in quotation marks."""
    words = [w.decode("utf-8", "replace") for w in text.encode("utf-8", "replace").split()]  # split as kernels.words does
    hit = [bool(found[0]) and found[1] % 2 == 0 for found in map(lexicon.token, words)]
    return " ".join(misspelt(w) if x else w for w, x in zip(words, hit, strict=True)), " ".join(f'"{w}"' if x else w for w, x in zip(words, hit, strict=True))


class Model:
    def __init__(self, weights: dict[str, float], regression: np.ndarray, ordinary: frozenset[str] = frozenset()):
        self.weights, self.regression, self.ordinary = weights, regression, ordinary


def _loaded(weights: dict[str, float], ordinary: frozenset[str]) -> tuple[Lexicon, kernels.IdCache]:
    """One lexicon and cache for each worker process and model."""

    def load():
        lexicon = Lexicon(weights, ordinary=ordinary)
        return lexicon, kernels.IdCache(lexicon.tokens, most=500_000, most_bytes=16 << 20)

    return kernels.worker_state(("toxicity", hash((tuple(sorted(weights.items())), ordinary))), load)


def parts(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """A few rows at a time, so that few texts are held as Python objects."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds sign: a hash of the whole set of a text's words."""
    for batch in parts(batches):
        signs = []
        for text in batch.column("text").to_pylist():
            words = sorted(set(text.lower().split()))  # with their digits and marks
            signs.append(int.from_bytes(hashlib.blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signs, pa.int64())], names=[*batch.schema.names, "sign"])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, most_terms: int = 4000) -> Model:
    """docs (doc_id, text) and the labels (doc_id, toxic) to learn from."""
    spark = docs.sparkSession
    labelled = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("y"))
    drawn = labelled.orderBy(F.xxhash64(F.lit(29), "doc_id"), "doc_id").limit(fit_rows)
    drawn = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(shared.cut(drawn)), "doc_id").select("text", "y")
    # copies have the same sign, so they are in one half
    half = F.pmod(F.xxhash64(F.lit(31), "sign"), F.lit(2)).cast("int")
    sample = shared.written(drawn.mapInArrow(signed, "text string, y int, sign long").withColumn("half", half), "labelled")
    # terms are chosen from texts of which each class has every set of words once, so that copies count once on both sides
    once = shared.written(sample.dropDuplicates(["y", "sign"]), "distinct")
    sizes = defaultdict(float, {(r["y"], r["half"]): float(r["count"]) for r in once.groupBy("y", "half").count().collect()})
    toxic, other = [[sizes[y, h] for h in (0, 1)] for y in (1, 0)]
    if not sum(toxic) or not sum(other):
        share = (sum(toxic) + 0.5) / (sum(toxic) + sum(other) + 2)
        return Model({}, np.array([math.log(share / (1 - share)), *[0.0] * (N_FEATURES - 1)]))

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            for text, h in zip(batch.column("text").to_pylist(), batch.column("half").to_pylist(), strict=True):
                terms = list(terms_of(set(_PARTS.findall(text.lower()))))
                yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "half": pa.array([h] * len(terms), pa.int32())})

    # a term needs this many toxic texts, so there are no more of them than terms in a text / 0.002
    enough = F.count("*") >= max(3.0, 0.002 * sum(toxic))
    seen = once.filter("y = 1").mapInArrow(shown, "term string, half int").groupBy("term")
    seen = seen.agg(F.count_if(F.col("half") == 0).alias("a"), F.count_if(F.col("half") == 1).alias("b"), enough.alias("enough"))
    positive = {r["term"]: (r["a"], r["b"]) for r in seen.filter("enough").select("term", "a", "b").collect()}
    sent = spark.sparkContext.broadcast(frozenset(positive))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int], int] = defaultdict(int)
        for batch in parts(batches):
            for text, h in zip(batch.column("text").to_pylist(), batch.column("half").to_pylist(), strict=True):
                for term in terms_of(set(_PARTS.findall(text.lower()))) & sent.value:
                    counts[term, h] += 1
        yield pa.RecordBatch.from_pydict({
            "term": pa.array([t for t, _ in counts], pa.string()), "half": pa.array([h for _, h in counts], pa.int32()), "n": pa.array(list(counts.values()), pa.int64()),
        })

    negative: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for r in once.filter("y = 0").mapInArrow(met, "term string, half int, n long").groupBy("term", "half").agg(F.sum("n").alias("n")).collect():
        negative[r["term"]][r["half"]] = r["n"]

    halves = [
        choose_terms({t: (p[h], negative[t][h]) for t, p in positive.items()}, toxic[h], other[h], most_terms) for h in (0, 1)
    ]
    weights = choose_terms({t: (sum(p), sum(negative[t])) for t, p in positive.items()}, sum(toxic), sum(other), most_terms)
    all_three = spark.sparkContext.broadcast([*halves, weights])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words an edit away from a term, with the texts that have them: of each half, by the terms of each lexicon."""
        lexicons = [Lexicon(w) for w in all_three.value]
        known: dict[str, tuple[bool, ...]] = {}
        counts: dict[tuple[str, int, int, int], int] = defaultdict(int)
        for batch in parts(batches):
            for text, y, h in zip(*(batch.column(c).to_pylist() for c in ("text", "y", "half")), strict=True):
                low = text.lower()
                for word in {*_PARTS.findall(low), *(w.strip(_MARKS) for w in low.split())}:
                    if word not in known:
                        short = not 4 <= len(word) <= 40
                        known[word] = tuple(not short and not x.exact(word) and bool(x.near(word)) for x in lexicons)
                        if len(known) > 500_000:
                            known.pop(next(iter(known)))
                    for k, found in enumerate(known.get(word, ())):
                        if found:
                            counts[word, k, h, y] += 1
        keys = list(counts)
        yield pa.RecordBatch.from_pydict({
            "word": pa.array([w for w, *_ in keys], pa.string()), **{c: pa.array([x[i] for x in keys], pa.int32()) for i, c in enumerate(("lexicon", "half", "y"), 1)},
            "n": pa.array(list(counts.values()), pa.int64()),
        })

    met_near = once.mapInArrow(close, "word string, lexicon int, half int, y int, n long")
    # what a half is fitted with comes from the other half alone
    met_near = met_near.filter("lexicon = 2 OR lexicon = half").groupBy("word", "lexicon").agg(*(F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (0, 1)))
    sums = [(toxic[0], other[0]), (toxic[1], other[1]), (sum(toxic), sum(other))]
    more = F.lit(False)
    for k, (n1, n0) in enumerate(sums):
        more |= (F.col("lexicon") == k) & ((F.col("n1") + 0.5) / (n1 + 1) > (F.col("n0") + 1.0) / (n0 + 2))
    # no more words than are an edit away from most_terms terms and in fit_rows texts
    ordinary: list[set[str]] = [set(), set(), set()]
    for r in met_near.filter(~more).select("word", "lexicon").collect():
        ordinary[r["lexicon"]].add(r["word"])
    both = spark.sparkContext.broadcast([(w, frozenset(o)) for w, o in zip(halves, ordinary, strict=False)])

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons = [Lexicon(w, ordinary=o) for w, o in both.value]
        caches = [kernels.IdCache(x.tokens, most=200_000, most_bytes=8 << 20) for x in lexicons]
        for batch in parts(batches):
            half_, y = batch.column("half").to_numpy(), batch.column("y").to_numpy()
            for run in kernels.runs(batch.column("text")):
                h = half_[run.first : run.last]
                x = [features(lexicons[k], caches[k], run) for k in (0, 1)]
                mine = np.where((h == 0)[:, None], x[1], x[0])  # terms of the other half
                yield pa.RecordBatch.from_pydict({"y": y[run.first : run.last], "x": pa.array(mine.tolist(), pa.list_(pa.float64()))})
            for k in (0, 1):
                texts = [t for t, h, toxic_ in zip(batch.column("text").to_pylist(), half_, y, strict=True) if toxic_ and h != k]
                made = [planted(t, lexicons[k]) for t in texts]
                for label, which, column in ((1, 0, 2), (0, 1, 3)):
                    for run in kernels.runs(pa.array([m[which] for m in made], pa.string())):
                        x = features(lexicons[k], caches[k], run)
                        x = x[(x[:, column] > 0) & (x[:, 1] == 0)]  # where nothing else was hit
                        yield pa.RecordBatch.from_pydict({"y": pa.array([label] * len(x), pa.int32()), "x": pa.array(x.tolist(), pa.list_(pa.float64()))})

    rows = sample.mapInArrow(crossed, "y int, x array<double>").toArrow()  # 3 * fit_rows rows at most
    x = np.array(rows.column("x").to_pylist())
    y = np.array(rows.column("y").to_pylist(), float)
    return Model(weights, fit_regression(x, y), frozenset(ordinary[2]))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score, 0 to 1, and predicted (1 from a score of 0.5)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = T.StructType([f for f in docs.schema.fields if f.name in kept]).add("score", T.DoubleType())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, cache = _loaded(sent.value.weights, sent.value.ordinary)
        for batch in batches:
            for run in kernels.runs(batch.column(text)):
                z = np.clip(features(lexicon, cache, run) @ sent.value.regression, -30, 30)
                here = batch.slice(run.first, len(run))
                yield pa.RecordBatch.from_arrays([*(here.column(c) for c in kept), pa.array(1 / (1 + np.exp(-z)))], names=[*kept, "score"])

    return docs.select(*kept).mapInArrow(work, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(doc_id: str = "doc_id"):
    """Rows that are never learnt from: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0
