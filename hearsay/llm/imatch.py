"""I-Match document fingerprints, in DataFrame functions only (operator 1).

Method: terms are lower-cased words; those whose document frequency lies in a band (inverse document frequency neither too
low nor too high) are kept; the distinct ones are sorted and hashed for each of several randomised subsets of the lexicon.
Two texts whose kept terms are equal have equal fingerprints, and texts that share most terms still agree in the subsets
that none of the other terms fall in.

The subsets are fixed for all texts: at every scale s the lexicon is parted at random, in two ways, into 2**s subsets, of
which the first ``CELLS`` count. A fingerprint lists those of three scales in a row, which follow from the text's number
of distinct terms, so that a subset has a few terms of a text, however long it is. An entry has eight hex digits: scale,
subset and four of the hash of the subset's terms in sorted order; subsets without a term are left out. Likeness is the share of equal
entries among the subsets that either text has terms in, at the scales that two fingerprints have in common; texts that
differ more than eightfold in their number of terms have none and no likeness.

A text that has no term of the band in its subsets (a language or topic of few documents, or frequent words only) is told
apart by all its terms instead; such entries have a mark in their scale and are never equal to others.

The lexicon is broadcast as 8-byte hashes: no more than (mean number of distinct terms of a text) * ``RAREST`` terms can
be in so many texts, whatever the number of texts.

Edge cases: null and empty texts, and texts without words, have the empty fingerprint, whose likeness to another empty
one is 1 and to any other 0; very long texts are read whole and send on a bounded number of terms; ties do not arise, since terms are
distinct; equal rows keep their own results and are next to each other in the order of doc_id; extra columns are left out;
an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.llm import shared

#: Subsets that count of each of the two ways to part the lexicon at a scale.
CELLS = 8
#: Scales of a fingerprint.
SCALES = 3
#: A kept term is in at least one of so many texts, and in at most one of COMMONEST.
RAREST, COMMONEST = 1000, 8
#: Fixed value: what separates words.
SPACE = r"[\x20\x09-\x0D]+"
#: Added to the scale of entries that are made of all terms.
UNBANDED = 64


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-cased words of a text."""
    words = F.split(F.lower(text), SPACE)
    return F.array_remove(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def lexicon(docs: DataFrame) -> DataFrame:
    """Hashes of the terms of docs (text) in the band."""
    total = F.broadcast(docs.agg(F.count("*").alias("total")))
    counts = docs.select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    low, high = F.greatest(F.lit(2.0), F.col("total") / RAREST), F.greatest(F.lit(3.0), F.col("total") / COMMONEST)
    return counts.join(total, (F.col("n") >= low) & (F.col("n") <= high)).select("term")


def scale(n_terms: Column) -> Column:
    """First scale of a text with so many distinct terms: its subsets keep some two to four of them."""
    return F.greatest(F.lit(0), F.floor(F.log2(F.greatest(n_terms, F.lit(1)))) - 1).cast("int")


def _chance(term: Column, way: int) -> Column:
    return F.xxhash64(term, F.lit(way))


def _cell(term: Column, way: int, at: Column) -> Column:
    """Which of 2**at subsets a term is in."""
    return _chance(term, way).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), at) - 1)


def sampled(found: Column, at: Column) -> Column:
    """Terms that are in a subset at the scale; those of the next scales are among them."""
    return F.filter(found, lambda t: (_cell(t, 0, at) < CELLS) | (_cell(t, 1, at) < CELLS))


def _entries(found: Column, at: Column, mark: int) -> Column:
    """Entries of a text's sorted terms at one scale: (scale, subset, hash) as one number."""
    in_way = lambda w: F.transform(F.filter(found, lambda t: _cell(t, w, at) < CELLS), lambda t: F.struct((_cell(t, w, at) + w * CELLS).alias("cell"), t.alias("term")))
    placed = F.array_sort(F.concat(in_way(0), in_way(1)))
    # one pass over the sorted terms: the hash of a subset takes in one term after the other
    start = F.struct(F.lit(-1).cast("long").alias("cell"), F.lit(0).cast("long").alias("hash"), F.array().cast("array<bigint>").alias("done"))
    entry = lambda acc: F.array(acc["cell"] * 65536 + acc["hash"].bitwiseAND(F.lit(65535)))
    closed = lambda acc: F.when(acc["cell"] < 0, acc["done"]).otherwise(F.concat(acc["done"], entry(acc)))

    def step(acc: Column, x: Column) -> Column:
        same = acc["cell"] == x["cell"]
        return F.struct(
            x["cell"].alias("cell"), F.xxhash64(F.when(same, acc["hash"]).otherwise(F.lit(0).cast("long")), x["term"]).alias("hash"),
            F.when(same, acc["done"]).otherwise(closed(acc)).alias("done"),
        )

    rows = F.aggregate(placed, start, step, closed)
    return F.transform(rows, lambda e: (at + mark).cast("long") * (1 << 24) + e)


def fingerprint(banded: Column, others: Column, first: Column) -> Column:
    """Entries of a text from the sampled terms that are in the band and those that are not."""
    every = lambda found, mark: F.flatten(F.array(*(_entries(found, first + i, mark) for i in range(SCALES))))
    return F.when(F.size(banded) > 0, every(banded, 0)).otherwise(every(others, UNBANDED))


def as_text(entries: Column) -> Column:
    return F.lower(F.array_join(F.transform(entries, lambda e: F.lpad(F.hex(e), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two lists of entries, 0 to 1."""
    at = lambda e: F.shiftright(e, 24)
    # both have three scales in a row: those from the later first one to the earlier last one are common
    low, high = F.greatest(F.array_min(a), F.array_min(b)), F.least(F.array_max(a), F.array_max(b))
    mine = lambda x: F.filter(x, lambda e: (at(e) >= at(low)) & (at(e) <= at(high)))
    subsets = lambda x: F.transform(mine(x), lambda e: F.shiftright(e, 16))
    share = F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(subsets(a), subsets(b))), F.lit(0))
    return F.when(a == b, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.least(F.lit(1.0), F.coalesce(share, F.lit(0.0)))).cast("double")


def fingerprints(rows: DataFrame, keys: list[str], texts: list[str], band: DataFrame) -> DataFrame:
    """rows with, for each column of texts, its entries in <column>_entries. A row's keys (no nulls) are its own."""
    for text in texts:
        rows = rows.withColumn(f"{text}_terms", terms(F.col(text)))
    for text in texts:
        first = scale(F.size(f"{text}_terms"))
        rows = rows.withColumn(f"{text}_scale", first).withColumn(f"{text}_terms", sampled(F.col(f"{text}_terms"), first))
    marked = lambda text, i: F.transform(f"{text}_terms", lambda t: F.struct(F.lit(i).alias("which"), t.alias("term")))
    each = F.array(*(marked(text, i) for i, text in enumerate(texts)))
    kept = [c for c in rows.columns if c not in texts and not c.endswith("_terms")]
    rows = rows.select(*kept, F.explode_outer(F.flatten(each)).alias("x")).select(*kept, "x.which", "x.term")
    inside = F.broadcast(band.select(F.col("term"), F.lit(True).alias("inside")))
    rows = rows.join(inside, "term", "left")
    gather = lambda i, cond: F.array_sort(F.collect_list(F.when((F.col("which") == i) & cond, F.col("term"))))
    lists = [gather(i, cond).alias(f"{text}_{name}") for i, text in enumerate(texts) for name, cond in (("in", F.col("inside").isNotNull()), ("out", F.col("inside").isNull()))]
    others = [F.first(c).alias(c) for c in kept if c not in keys]
    rows = rows.groupBy(*keys).agg(*others, *lists)
    made = [fingerprint(F.col(f"{text}_in"), F.col(f"{text}_out"), F.col(f"{text}_scale")).alias(f"{text}_entries") for text in texts]
    return rows.select(*(c for c in kept if not c.endswith("_scale")), *made)


def with_next(docs: DataFrame, rows_at_once: int = 4096, splits: int = 200) -> DataFrame:
    """docs (doc_id, text) in descending order of doc_id: bucket, place, doc_id, text; next_text, next_bucket and next_place of
    the row after it (after the last: the first).

    Rows are dealt into ranges of doc_id by its quantiles, so no task sorts all of them; each range also gets the first row
    of the range after it.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    stats = docs.agg(F.count("*").alias("n"), F.percentile_approx("doc_id", F.lit([i / splits for i in range(1, splits)]), 10_000).alias("q")).first()
    edges = sorted(set(stats["q"] or []))
    fine = max(1, -(-stats["n"] // (rows_at_once * splits)))
    if edges:
        # the range, and within it an equal share of the distance to its end
        low = F.array(*[F.lit(e).cast("long") for e in edges])
        at = F.size(F.filter(low, lambda e: e <= F.col("doc_id")))
        start, end = F.try_element_at(low, at), F.try_element_at(low, at + 1)
        part = F.floor((F.col("doc_id") - start) * F.lit(float(fine)) / F.nullif(end - start, F.lit(0)))
        bucket = at.cast("long") * fine + F.when((at > 0) & (at < len(edges)), F.coalesce(part, F.lit(0))).otherwise(0)
    else:
        bucket = F.lit(0).cast("long")
    dealt = docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(bucket).cast("long"))
    order = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63) + 1)), "text")
    # one row for each range
    heads = dealt.groupBy("bucket").agg(F.max_by(F.struct("doc_id", "text"), order).alias("head"))
    ranges = Window.orderBy(F.desc("bucket"))
    after = shared.cut(heads.select("bucket")).withColumn("following", F.lead("bucket").over(ranges)).withColumn("first", F.max("bucket").over(Window.partitionBy()))
    after = after.select("bucket", F.coalesce("following", "first").alias("following"))
    extra = after.join(heads.withColumnRenamed("bucket", "following"), "following").select(F.col("head.doc_id").alias("doc_id"), F.col("head.text").alias("text"), "bucket", "following")
    every = dealt.select("doc_id", "text", "bucket", F.lit(None).cast("long").alias("following")).unionByName(extra)
    window = Window.partitionBy("bucket").orderBy(F.col("following").isNotNull(), F.col("doc_id").desc_nulls_last(), F.desc("text"))
    after = F.lead("following").over(window)
    placed = every.withColumn("next_text", F.lead("text").over(window)).withColumn("place", F.row_number().over(window)).withColumn("after", after)
    next_place = F.when(F.col("after").isNull(), F.col("place") + 1).otherwise(1)
    placed = placed.filter("following IS NULL").withColumn("next_bucket", F.coalesce("after", "bucket")).withColumn("next_place", next_place)
    return placed.select("bucket", "place", "doc_id", "text", "next_text", "next_bucket", "next_place")


def edited(docs: DataFrame) -> DataFrame:
    """with_next's rows with n_chars and edited: the last third of the text replaced by the start of the next one."""
    n = F.char_length("text")
    text = F.concat(F.expr("left(text, int(char_length(text) - floor(char_length(text) / 3)))"), F.expr("left(next_text, int(floor(char_length(text) / 3)))"))
    return docs.withColumn("n_chars", n.cast("long")).withColumn("edited", text)


def compare(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, the fingerprints of the text and its edited text, near_edited and
    near_next (likeness to the edited text and to the next document)."""
    band = shared.cut(lexicon(docs))
    rows = edited(with_next(docs)).withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256))
    rows = rows.select("bucket", "place", "next_bucket", "next_place", "doc_id", "n_chars", "edited_sha256", "text", "edited")
    both = shared.written(fingerprints(rows, ["bucket", "place"], ["text", "edited"], band), "fingerprints")
    after = both.select(F.col("bucket").alias("next_bucket"), F.col("place").alias("next_place"), F.col("text_entries").alias("next"))
    both = both.join(after, ["next_bucket", "next_place"])
    return both.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("text_entries")).alias("fingerprint"), as_text(F.col("edited_entries")).alias("edited_fingerprint"),
        likeness(F.col("text_entries"), F.col("edited_entries")).alias("near_edited"), likeness(F.col("text_entries"), F.col("next")).alias("near_next"),
    )
