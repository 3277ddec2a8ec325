"""Licence families of paragraphs, in DataFrame functions only (operator 8).

Method: a paragraph (a line of a text, or lines next to each other that a notice is wrapped over) is a sparse set of word 1- and
2-grams. A logistic regression for each family, trained here, gives its probability; the family of the highest is predicted,
or the unknown class if that is below the family's floor. The floor is calibrated on paragraphs that the fit has not seen, hard
ones among them. A template comparison then confirms the prediction: the share of the 1- and 2-grams of one of the predicted
family's templates that the paragraph has must be at least ``CONFIRM``, else the class is unknown.

Training is by full gradient steps as joins and sums over (paragraph, gram, value) rows. Positives are made from the templates
below by leaving words out. Hard negatives are templates that have lost too many words to be confirmed, and the corpus' own
lines that have a licence word and agree with no template; the other negatives are lines without one. Of each of these two
kinds of lines ``negatives`` distinct ones are drawn, those of smallest hash, so that a line with many copies counts once and
their number doesn't grow with the input. The weights are broadcast: a row for each gram of the templates.

Lines are joined as far as a notice of the longest template's length can be wrapped, but not over blank lines. Candidates are
paragraphs that hold a word of ``_telling``, without which too few grams are left of every template; each is classified. Of
confirmed paragraphs of a family that overlap, the one that ends first counts. Lines with a licence word (WORDS) that are in no
paragraph of a confirmed family are of the unknown class.

Edge cases: very long texts are read whole; work grows with their lines, also where each of them is a notice; null and
empty texts have no paragraphs and no licence; equal rows are scored each for itself; a document
takes the families of all its paragraphs; an empty table gives an empty one; extra columns are left out.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearsay.llm import shared

#: Licence families and phrases of their notices, as public licence texts word them.
TEMPLATES = (
    ("agpl-3.0", "licensed under the gnu affero general public license, version 3"),
    ("apache-2.0", "licensed under the apache license, version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("boost-1.0", "distributed under the boost software license, version 1.0"),
    ("bsd", "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by", "licensed under cc by 4.0"),
    ("cc-by-nc", "licensed under cc by-nc 4.0"),
    ("cc-by-nc", "licensed under a creative commons attribution-noncommercial 4.0 international license"),
    ("cc-by-sa", "licensed under cc by-sa 4.0"),
    ("cc-by-sa", "licensed under a creative commons attribution-sharealike 4.0 international license"),
    ("cc0", "to the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0"),
    ("gpl-2.0", "this work is licensed under the gnu general public license, version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license, version 3"),
    ("gpl-3.0", "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license, v. 2.0"),
    ("odbl", "made available under the open database license"),
    ("proprietary", "all rights reserved"),
    ("public-domain", "this work is in the public domain"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Share of a template's grams that a paragraph must have.
CONFIRM = 0.7
#: Licence words: a line with one of them and without a confirmed notice is of the unknown class.
WORDS = r"(?i)licen[cs]|copyright|rights reserved|public domain|redistribut|creative commons|free software|permission is hereby"


def grams(text: Column) -> Column:
    """Distinct 1- and 2-grams of the lower-cased words of a text."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.\-]+"), lambda w: w != "")
    words = F.transform(words, lambda w: F.regexp_replace(w, r"^[.\-]+|[.\-]+$", ""))
    words = F.filter(words, lambda w: w != "")
    pairs = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
    return F.array_distinct(F.filter(F.concat(words, pairs), lambda g: g.isNotNull()))


def templates(spark: SparkSession) -> DataFrame:
    rows = [(i, family, text) for i, (family, text) in enumerate(TEMPLATES)]
    return spark.createDataFrame(rows, "template int, family string, text string").withColumn("grams", grams(F.col("text")))


def _fixed(found: list) -> tuple[Column, Column]:
    """The templates as an array of (family, grams), and all their grams, for use in expressions."""
    rows = [{"family": r["family"], "grams": r["grams"]} for r in found]
    every = sorted({g for r in rows for g in r["grams"]})
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<family: string, grams: array<string>>>"), F.from_json(F.lit(json.dumps(every)), "array<string>")


def agreed(grams: Column, fixed: Column) -> Column:
    """Families of the templates of whose grams a paragraph has CONFIRM or more."""
    share = lambda t: F.size(F.array_intersect(grams, t["grams"])) / F.size(t["grams"])
    return F.transform(F.filter(fixed, lambda t: share(t) >= CONFIRM), lambda t: t["family"])


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that later expressions take as it is; exploded, so that it isn't made anew wherever they name it."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def paragraphs(docs: DataFrame, negatives: int = 2000, versions: int = 12) -> DataFrame:
    """What is learnt from: family (empty: none), held, grams (those of templates alone, sorted) and n, the number of paragraphs
    that are alike in these."""
    spark = docs.sparkSession
    known = templates(spark)
    fixed, vocabulary = _fixed(known.collect())  # fixed rows
    # versions of a template lack words by chance, one in eight or, of those that are to be unknown, most of them
    least = F.when(F.col("version") < versions, 1).otherwise(5)
    words = F.filter(F.split("text", " "), lambda w: F.pmod(F.xxhash64(F.col("version"), w), F.lit(8)) >= least)
    made = known.select("family", "text", F.explode(F.sequence(F.lit(0), F.lit(2 * versions - 1))).alias("version"))
    line = F.when(F.col("version") == 0, F.col("text")).otherwise(F.concat_ws(" ", words))
    made = _once(made.select("family", line.alias("line"), (F.col("version") % 4 == 3).alias("held")), "grams", grams(F.col("line")))
    made = _once(made, "agreed", agreed(F.col("grams"), fixed))
    made = made.filter("array_contains(agreed, family) OR size(agreed) = 0").withColumn("family", F.when(F.size("agreed") > 0, F.col("family")).otherwise(""))
    lines = docs.select(F.explode(F.split("text", r"\R")).alias("line")).filter(F.length("line") <= 1000)
    h = F.xxhash64(F.lit(7), "line")
    lines = lines.select("line", h.alias("h"), F.col("line").rlike(WORDS).alias("asked"))
    # hashes below a bound that some more than enough lines have by their estimated number; then the smallest of these
    counts = {r["asked"]: r["n"] for r in lines.groupBy("asked").agg(F.approx_count_distinct("h").alias("n")).collect()}
    rate = F.when(F.col("asked"), F.lit(1.5 * negatives / max(1, counts.get(True, 0)))).otherwise(F.lit(1.5 * negatives / max(1, counts.get(False, 0))))
    near = shared.written(lines.filter(F.shiftrightunsigned("h", 11) * F.lit(2.0**-53) < rate).dropDuplicates(["line"]), "lines")
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.shiftrightunsigned("h", 11), "line"))  # of some 3 * negatives lines
    drawn = near.withColumn("place", place).filter(F.col("place") <= negatives)
    drawn = _once(drawn.select(F.lit("").alias("family"), "line", (F.pmod("h", F.lit(4)) == 3).alias("held")), "grams", grams(F.col("line")))
    drawn = drawn.filter(F.size(agreed(F.col("grams"), fixed)) == 0)
    rows = made.drop("agreed").unionByName(drawn).dropDuplicates(["family", "line", "held"])
    rows = rows.select("family", "held", F.array_sort(F.array_intersect("grams", vocabulary)).alias("grams"))
    return rows.groupBy("family", "held", "grams").agg(F.count("*").alias("n"))


def train(docs: DataFrame, negatives: int = 2000, versions: int = 12, steps: int = 20, ridge: float = 0.05) -> DataFrame:
    """Weights: of (family), gram, weight, bias, floor. One row for each family and gram of a template."""
    families = sorted({f for f, _ in TEMPLATES})
    # bounded from here on: the drawn lines and the templates' versions
    rows = shared.written(paragraphs(docs, negatives, versions).withColumn("id", F.xxhash64("family", "held", "grams")).coalesce(4), "paragraphs")
    # the empty gram, which every paragraph has, stands for the bias
    pairs = shared.written(rows.select("id", "held", "n", (F.size("grams") + 1).alias("size"), F.explode(F.array_append("grams", F.lit(""))).alias("gram")), "grams")
    each_of = range(len(families))
    # weights of each family, and how they last moved
    weights = pairs.select("gram").distinct().selectExpr("gram", *(f"0D AS w{k}" for k in each_of), *(f"0D AS v{k}" for k in each_of)).coalesce(1)
    weights = shared.written(weights, "weights")

    def probabilities(pairs: DataFrame, weights: DataFrame) -> DataFrame:
        z = pairs.join(F.broadcast(weights), "gram").groupBy("id").agg(*(F.expr(f"sum(w{k}) AS z{k}") for k in each_of))
        return z.selectExpr("id", *(f"1 / (1 + exp(-z{k})) AS p{k}" for k in each_of))

    fit = pairs.filter("NOT held")
    told = rows.filter("NOT held").select("id", "family")
    # steps by the gradient over what bounds the curvature, since grams of a template come together, with momentum
    for i in range(steps):
        p = probabilities(fit, weights).join(F.broadcast(told), "id")
        sums = fit.join(F.broadcast(p), "id").groupBy("gram").agg(
            *(F.expr(f"sum(n * (int(family = '{f}') - p{k})) AS g{k}") for k, f in enumerate(families)),
            *(F.expr(f"sum(n * size * p{k} * (1 - p{k})) AS h{k}") for k in each_of),
        )
        moved = weights.join(F.broadcast(sums), "gram").withColumn("keep", F.lit(i / (i + 3)))
        moved = moved.selectExpr("gram", *(f"w{k}" for k in each_of), *(f"greatest(-2D, least(2D, (g{k} - {ridge} * w{k}) / (h{k} + {ridge}))) + keep * v{k} AS v{k}" for k in each_of))
        weights = shared.written(moved.selectExpr("gram", *(f"w{k} + v{k} AS w{k}" for k in each_of), *(f"v{k}" for k in each_of)).coalesce(1), "weights")
    # the floor is where unseen paragraphs are told apart with fewest errors, halfway to the next lower probability
    unseen = probabilities(pairs.filter("held"), weights).join(rows.select("id", "family", "n"), "id")
    unseen = unseen.select("family", "n", F.explode(F.array(*(F.struct(F.lit(f).alias("of"), F.col(f"p{k}").alias("p")) for k, f in enumerate(families)))).alias("x")).select("family", "n", "x.*")
    mine = F.col("family") == F.col("of")
    each = unseen.groupBy("of", "p").agg(F.sum(F.when(mine, F.col("n")).otherwise(0)).alias("mine"), F.sum(F.when(mine, 0).otherwise(F.col("n"))).alias("others"))
    by_p = Window.partitionBy("of").orderBy("p")  # of held rows
    below, above = by_p.rowsBetween(Window.unboundedPreceding, -1), by_p.rowsBetween(0, Window.unboundedFollowing)
    errors = F.coalesce(F.sum("mine").over(below), F.lit(0)) + F.sum("others").over(above)
    tried = each.select("of", "p", errors.alias("errors"), F.coalesce(F.max("p").over(below), F.lit(0.0)).alias("lower"))
    floor = F.min_by((F.col("p") + F.col("lower")) / 2, F.struct("errors", "p"))
    floors = tried.groupBy("of").agg(F.greatest(F.lit(0.05), F.least(F.lit(0.8), floor)).alias("floor"))
    long = weights.select("gram", F.explode(F.array(*(F.struct(F.lit(f).alias("of"), F.col(f"w{k}").alias("weight")) for k, f in enumerate(families)))).alias("x")).select("gram", "x.*")
    bias = long.filter("gram = ''").select("of", F.col("weight").alias("bias"))
    return shared.cut(long.filter("gram <> ''").join(F.broadcast(bias), "of").join(F.broadcast(floors), "of").coalesce(1))


def _telling(found: list[list[str]]) -> list[str]:
    """Words without which a text has less than CONFIRM of every template's grams: those of fewest templates first."""
    held = Counter(w for gs in found for w in gs if " " not in w)
    out: set[str] = set()
    for gs in found:
        left = lambda: sum(not out & set(g.split()) for g in gs) / len(gs)  # noqa: B023, E731
        for w in sorted((g for g in gs if " " not in g), key=lambda w: (held[w], -len(w), w)):
            if left() < CONFIRM:
                break
            if len(w) > 3:
                out.add(w)
        assert left() < CONFIRM, gs
    return sorted(out)


def scan(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, families (sorted, joined by a comma), n_licences and n_unknown (paragraphs), probability
    (the highest of a confirmed paragraph; null without one)."""
    spark = docs.sparkSession
    known = templates(spark).collect()  # fixed rows
    found = [(r["family"], r["grams"]) for r in known]
    literal, vocabulary = _fixed(known)
    longest = max(sum(" " not in g for g in gs) + 1 for _, gs in found) + 8  # words; some come twice
    telling = rf"(?i)\b(?:{'|'.join(_telling([gs for _, gs in found]))})\b"
    text = F.coalesce("text", F.lit(""))
    lines = F.when(text.rlike(telling) | text.rlike(WORDS), F.split(text, r"\R"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.explode_outer(F.array(lines)).alias("lines"))
    facts = F.struct(
        F.transform("lines", lambda x: F.regexp_count(x, F.lit(r"\S+"))).alias("sizes"), F.transform("lines", lambda x: x.rlike(telling)).alias("told"),
        F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(WORDS), i)), lambda i: i.isNotNull()).alias("asked"),
    )
    # exploded, so that none of these arrays is made anew for each line
    rows = rows.select("row", "doc_id", "lines", F.explode_outer(F.array(facts)).alias("f")).select("row", "doc_id", "lines", "f.*")
    last = F.size("lines") - 1

    def ends(i: Column) -> Column:
        far = F.filter(F.sequence(i, F.least(last, i + longest)), lambda j: F.exists(F.slice("told", i + 1, j - i + 1), lambda t: t))
        inner = lambda j: F.aggregate(F.slice("sizes", i + 2, F.greatest(j - i - 1, F.lit(0))), F.lit(0), lambda a, n: a + n)
        whole = lambda j: F.forall(F.slice("sizes", i + 1, j - i + 1), lambda n: n > 0) & (inner(j) <= longest)
        return F.transform(F.filter(far, lambda j: (i == j) | whole(j)), lambda j: F.struct(i.alias("i"), j.alias("j")))

    starts = F.filter(F.sequence(F.lit(0), last), lambda i: F.exists(F.slice("told", i + 1, longest + 1), lambda t: t))
    spans = F.when(F.exists("told", lambda t: t), F.flatten(F.transform(starts, ends)))
    rows = rows.select("row", "doc_id", "asked", "lines", F.explode_outer(F.array(spans)).alias("spans"))
    joined = lambda x: F.array_join(F.slice("lines", x["i"] + 1, x["j"] - x["i"] + 1), " ")
    known = F.transform("spans", lambda x: F.struct(x["i"].alias("i"), x["j"].alias("j"), F.array_intersect(grams(joined(x)), vocabulary).alias("grams")))
    rows = rows.select("row", "doc_id", "asked", F.explode_outer(F.array(known)).alias("known"))
    # asked goes with the first span, and then its first gram, alone: a text of many licence lines isn't copied to each of its spans
    first = lambda place, name: F.when(F.coalesce(place, F.lit(0)) == 0, F.col(name)).alias(name)
    rows = rows.select("row", "doc_id", "asked", F.posexplode_outer("known").alias("place", "x")).select("row", "doc_id", first(F.col("place"), "asked"), "x.*")
    each = rows.select("row", "doc_id", "asked", "i", "j", "grams", F.posexplode_outer("grams").alias("place", "gram"))
    each = each.select("row", "doc_id", "i", "j", "gram", *(first(F.col("place"), c) for c in ("asked", "grams")))
    fitted = {r["of"]: (r["bias"], r["floor"]) for r in weights.select("of", "bias", "floor").distinct().collect()}  # a row a family
    wide = weights.groupBy("gram").pivot("of", sorted(fitted)).agg(F.first("weight"))
    wide = wide.select("gram", *(F.col(f"`{f}`").alias(f"w{n}") for n, f in enumerate(sorted(fitted))))
    scored = each.join(F.broadcast(wide), "gram", "left").groupBy("row", "doc_id", "i", "j").agg(
        F.first("asked", ignorenulls=True).alias("asked"), F.first("grams", ignorenulls=True).alias("grams"),
        *(F.sum(f"w{n}").alias(f"z{n}") for n in range(len(fitted))),
    )
    p = lambda n, bias: 1 / (1 + F.exp(-(F.coalesce(F.col(f"z{n}"), F.lit(0.0)) + bias)))
    classes = (F.struct(p(n, fitted[f][0]).alias("p"), F.lit(f).alias("of"), F.lit(fitted[f][1]).alias("floor")) for n, f in enumerate(sorted(fitted)))
    best = scored.select("row", "doc_id", "i", "j", "asked", "grams", F.array_max(F.array(*classes)).alias("b"))
    sure = F.col("i").isNotNull() & (F.col("b.p") >= F.col("b.floor"))  # else the class is unknown
    mine = F.filter(literal, lambda t: t["family"] == F.col("b.of"))
    one = F.when(sure & (F.size(agreed(F.col("grams"), mine)) > 0), F.struct("j", (-F.col("i")).alias("back"), F.col("b.of").alias("of"), F.col("b.p").alias("p")))
    out = best.groupBy("row", "doc_id").agg(F.first("asked", ignorenulls=True).alias("asked"), F.array_sort(F.collect_list(one)).alias("all"))
    # in the order of their ends, a span is free if the last one taken of its family ends before it starts
    free = lambda a, x: F.coalesce(F.try_element_at(a, F.lit(-1))["j"] < -x["back"], F.lit(True))
    families = F.array(*map(F.lit, sorted({f for f, _ in found})))
    of_family = lambda f: F.aggregate(F.filter("all", lambda x: x["of"] == f), F.slice("all", 1, 0), lambda a, x: F.when(free(a, x), F.array_append(a, x)).otherwise(a))
    taken = F.flatten(F.transform(families, of_family))
    out = out.select("doc_id", "asked", F.explode(F.array(taken)).alias("taken"))
    unknown = F.array_except("asked", F.flatten(F.transform("taken", lambda x: F.sequence(-x["back"], x["j"]))))
    return out.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(F.coalesce(F.transform("taken", lambda x: x["of"]), F.array().cast("array<string>")))), ",").alias("families"),
        F.when(F.col("taken").isNull(), 0).otherwise(F.size("taken")).cast("long").alias("n_licences"),
        F.when(F.col("asked").isNull(), 0).otherwise(F.size(unknown)).cast("long").alias("n_unknown"),
        F.array_max(F.transform("taken", lambda x: x["p"])).alias("probability"),
    )
