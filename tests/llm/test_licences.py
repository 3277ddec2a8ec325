import math
import re
import time

from hearsay.llm import licences, queries

#: The corpus' licence lines and what they are.
LINES = {
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
    "All rights reserved.": "proprietary",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "Released under the MIT License.": "mit",
    "Licensed under the Apache License, Version 2.0.": "apache-2.0",
}


def test_query_finds_every_licence_line(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op8_licences(spark, sf_dir).collect()}
    docs = queries.read(spark, sf_dir, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        lines = [LINES[x.strip()] for x in (d.text or "").split("\n") if x.strip() in LINES]
        assert got[d.doc_id].families == ",".join(sorted(set(lines))), d.doc_id
        assert got[d.doc_id].n_licences == len(lines)


def test_families_unknown_licences_and_odd_rows(spark):
    train = queries.read(spark, "/root/testdata/sf0.001", "documents")
    rows = [
        (1, "x y\nLicensed under CC BY-SA 4.0\nz"), (2, "released under the MIT license\nAll rights reserved"), (3, None), (4, ""), (5, "\n \n"),
        (6, "Licensed under the Corner Shop Beer License, 17th draft of nobody."), (7, "He was licensed to drive a lorry."), (8, "word " * 20_000 + "\nreleased under the mit license"),
        (9, "This source code form is subject to the terms of the Mozilla Public License, v. 2.0."), (2, "released under the MIT license\nAll rights reserved"),
        (10, "The public domain is wide."), (None, "Released under the MIT License."),
    ]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, families string").repartition(3)
    weights = licences.train(train)
    got = [(r.doc_id, r.families, r.n_licences, r.n_unknown) for r in licences.scan(docs, weights).collect()]
    want = [
        (1, "cc-by-sa", 1, 0), (2, "mit,proprietary", 2, 0), (3, "", 0, 0), (4, "", 0, 0), (5, "", 0, 0), (6, "", 0, 1), (7, "", 0, 1), (8, "mit", 1, 0),
        (9, "mpl-2.0", 1, 0), (2, "mit,proprietary", 2, 0), (10, "", 0, 1), (None, "mit", 1, 0),
    ]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert licences.scan(docs.limit(0), weights).collect() == []
    assert licences.scan(docs, licences.train(docs.limit(0))).count() == len(rows)


def test_wrapped_notices(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification,\nare permitted provided that the following conditions are met:"
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License"
    apache = "you may not use this file except in\ncompliance with the License"
    rows = [
        (1, bsd), (2, "a b\n" + gpl + "\nc d"), (3, apache), (4, bsd.replace(" ", "\n")), (5, bsd.replace("\n", "\n\n")), (6, bsd + "\n\n" + bsd),
        (7, "word " * 1_000_001 + "released under the mit license"), (8, "you may not use this file except in compliance with the"), (9, gpl + "\nAll rights reserved"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weights = licences.train(queries.read(spark, "/root/testdata/sf0.001", "documents"))
    got = {r.doc_id: (r.families, r.n_licences, r.n_unknown) for r in licences.scan(docs, weights).collect()}
    assert got == {
        1: ("bsd", 1, 0), 2: ("gpl-3.0", 1, 0), 3: ("apache-2.0", 1, 0), 4: ("bsd", 1, 0), 5: ("", 0, 1), 6: ("bsd", 2, 0), 7: ("mit", 1, 0), 8: ("apache-2.0", 1, 0),
        9: ("gpl-3.0,proprietary", 2, 0),
    }


def test_many_notices_in_one_text_and_copies_of_one_line(spark):
    train = queries.read(spark, "/root/testdata/sf0.001", "documents")
    copies = spark.range(5000).selectExpr("id AS doc_id", "'one and the same line' AS text")
    weights = licences.train(train.select("doc_id", "text").unionByName(copies))
    docs = spark.createDataFrame([(1, "All rights reserved.\n" * 4000), (2, "Released under the MIT License.\n\nlicensed to nobody\n\n" * 1000)], "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: (r.families, r.n_licences, r.n_unknown) for r in licences.scan(docs, weights).collect()}
    assert got == {1: ("proprietary", 4000, 0), 2: ("mit", 1000, 1000)}
    assert time.perf_counter() - began < 60


def brute(text, weights):
    """What scan says of a text, from every run of lines that a notice may be wrapped over."""

    def grams(t):
        words = [w for w in (re.sub(r"^[.\-]+|[.\-]+$", "", x) for x in re.split(r"[^\w.\-]+", t.lower().replace("_", " "))) if w]
        return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}

    known = [(f, grams(t)) for f, t in licences.TEMPLATES]
    longest = max(sum(" " not in g for g in gs) + 1 for _, gs in known) + 8
    lines = re.split(r"\r\n|\n", text)
    found = []
    for i in range(len(lines)):
        for j in range(i, min(len(lines), i + longest + 1)):
            part = lines[i : j + 1]
            if j > i and (not all(x.split() for x in part) or sum(len(x.split()) for x in part[1:-1]) > longest):
                continue
            own = grams(" ".join(part))
            p, of = max((1 / (1 + math.exp(-(bias + sum(w.get(g, 0.0) for g in own)))), f) for f, (w, bias, floor) in weights.items())
            if p >= weights[of][2] and any(f == of and len(own & gs) / len(gs) >= licences.CONFIRM for f, gs in known):
                found.append((j, -i, of))
    taken, last = [], {}
    for j, back, of in sorted(found):
        if last.get(of, -1) < -back:
            taken.append((j, -back, of))
            last[of] = j
    inside = {k for j, i, _ in taken for k in range(i, j + 1)}
    unknown = sum(bool(re.search(licences.WORDS, x)) and k not in inside for k, x in enumerate(lines))
    return ",".join(sorted({t[2] for t in taken})), len(taken), unknown


def test_every_template_and_hard_negatives_against_brute_force(spark):
    """Each template is found, wrapped or not; paragraphs made of a licence's words that are no notice are unknown; all as a
    scorer says that looks at every run of lines."""
    weights = licences.train(queries.read(spark, "/root/testdata/sf0.01", "documents"))
    model = {}
    for r in weights.collect():
        model.setdefault(r["of"], ({}, r.bias, r.floor))[0][r.gram] = r.weight
    hard = [
        "licensed under the corner shop license, version 2.0", "this work is licensed under", "the license, version 3, of nobody", "rights reserved for all", "software in the public eye, with copyright",
        "the gnu general was licensed to drive", "permission is hereby denied, free of charge", "redistribution of wealth with or without the source",
    ]
    texts = [t for _, t in licences.TEMPLATES]
    texts += ["a b c\n" + re.sub(r"((?:\S+ ){4})", lambda m: m[0].strip() + "\n", t) + "\nd e f" for t in texts] + hard + ["\n\n".join(hard), texts[0] + "\n" + hard[0] + "\n" + texts[3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.families, r.n_licences, r.n_unknown) for r in licences.scan(docs, weights).collect()}
    assert got == {i: brute(t, model) for i, t in enumerate(texts)}
    n = len(licences.TEMPLATES)
    assert [got[i][0] for i in range(n)] == [f for f, _ in licences.TEMPLATES]
    assert all(got[2 * n + i][0] == "" for i in range(len(hard)))


def test_the_classifier_decides(spark):
    """Paragraphs that a template would confirm are unknown where the classifier doesn't give them its family."""
    weights = licences.train(queries.read(spark, "/root/testdata/sf0.001", "documents"))
    docs = spark.createDataFrame([(1, "Released under the MIT License."), (2, "All rights reserved.")], "doc_id long, text string")
    none = weights.selectExpr("of", "gram", "0D AS weight", "bias", "floor")
    assert [(r.families, r.n_unknown) for r in licences.scan(docs, none).orderBy("doc_id").collect()] == [("", 1), ("", 1)]
    other = weights.filter("of <> 'mit'")
    assert [(r.families, r.n_unknown) for r in licences.scan(docs, other).orderBy("doc_id").collect()] == [("", 1), ("proprietary", 0)]
