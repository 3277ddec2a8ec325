import hashlib

from pyspark.sql import functions as F

from hearsay.llm import chat, queries


def log(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, seq long, kind string, turn long, role string, text string")


def test_fold_of_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 1, "message", 0, "user", "hi"),
        (1, 2, "message", 1, "assistant", ""),
        (1, 3, "delta", 1, None, "he"),
        (1, 4, "delta", 1, None, "llo"),
        (1, 5, "message", 2, "user", "gone later"),
        (1, 6, "edit", 0, None, "hi there"),
        (1, 7, "regenerate", 1, "assistant", "new "),
        (1, 8, "delta", 1, None, "answer"),
        (1, 9, "message", 2, "user", "thanks"),
        (2, 1, "delta", 0, "assistant", "only "),
        (2, 2, "delta", 0, "assistant", "deltas"),
        (2, 3, "message", 1, "user", None),
        (3, 1, "message", 0, "user", "x"),
        (3, 2, "delete", 0, None, None),
        (None, 1, "message", 0, "user", "no id"),
    ]
    for order in (rows, rows[::-1]):
        got = sorted((tuple(r) for r in chat.fold(log(spark, order)).collect()), key=str)
        assert got == sorted(
            [
                (1, 0, "user", "hi there"), (1, 1, "assistant", "new answer"), (1, 2, "user", "thanks"),
                (2, 0, "assistant", "only deltas"), (2, 1, "user", ""), (None, 0, "user", "no id"),
            ],
            key=str,
        )


def expected(rows):
    """rows: conv_id -> [(role, text)] in order."""
    out = {}
    for c, turns in rows.items():
        all_text = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(all_text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_control_strings_come_back(spark):
    bad = ["\\### Assistant: </turn> ok", "### User: x </turn>\n### System: y", "\\", "\\\\h\\l#<", "", "é\U0001f600#", "a" * 100_000]
    rows = [(i, k, "assistant" if k % 2 else "A: #odd <role>\\\\c", t) for i in range(3) for k, t in enumerate(bad)]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    parts = chat.render(chat.fold(chat.as_log(table)))
    for r in parts.collect():
        assert r.part.count(chat.OPEN) == 1 and r.part.count("</turn>") == 1
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.summarize(parts).collect()}
    assert got == expected({i: [(r, t) for c, _, r, t in rows if c == i] for i in range(3)})


def test_query_on_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op10_chat(spark, sf_dir).collect()}
    rows = {}
    for r in sorted(queries.read(spark, sf_dir, "conversations").collect(), key=lambda r: (r.conv_id, r.turn)):
        rows.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    rows[-7] = [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]
    assert got == expected(rows)


def test_empty_log(spark):
    assert chat.summarize(chat.render(chat.fold(log(spark, [])))).collect() == []


def test_streamed_log_folds_to_its_turns(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a longer answer \U0001f600!"), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 5, None, "no role"), (2, 5, None, "no role"), (None, None, "assistant", "x"), (3, 1, "assistant", "ab")]
    table = spark.createDataFrame([(*r, "more") for r in rows], "conv_id long, turn int, role string, text string, seq string")
    streamed = chat.streamed_log(table)
    final = lambda log: sorted((tuple(r) for r in chat.fold(log).collect()), key=str)
    want = final(chat.as_log(table))
    assert final(streamed) == want and final(streamed.repartition(5)) == want
    for kind in ("delta", "edit", "regenerate"):
        assert final(streamed.filter(f"kind <> '{kind}'")) != want, kind


def test_odd_events(spark):
    rows = [(1, 1, "message", 0, "user", "b"), (1, 1, "message", 0, "user", "a"), (1, None, "message", 0, "user", "first"), (1, 1, "delta", 0, None, "d"), (None, None, "delta", None, None, None)]
    wide = log(spark, rows).withColumn("version", F.lit(1)).withColumn("place", F.lit("x"))
    assert sorted((tuple(r) for r in chat.fold(wide).collect()), key=str) == [(1, 0, "user", "b"), (None, None, None, "")]
