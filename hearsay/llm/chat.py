"""Chat formatting by event-sourced reconstruction (operator 10).

A conversation is a log: rows of (conv_id, seq, kind, turn, role, text). Logs are partitioned by conversation and
sorted by seq; folding gives the final messages:

* ``message``, ``edit`` and ``regenerate`` set a turn's text; ``delta`` adds to it; ``delete`` takes the turn away;
* a ``regenerate`` of a turn also ends every later turn that was logged before it;
* a turn's role is the last one that is not null; a null text is empty; deltas before any ``message`` build it.

Messages are then rendered with a template that marks turns. Inside texts, the characters that control strings are
made of are escaped, so a text never holds a control string and every text is read back exactly.

A conversation is never gathered into one row: its formatted text is one part per turn, in turn order. Windows and
the reader stream through parts, so memory doesn't grow with the longest conversation.

Ties: events of equal seq fold in the order of (turn, kind, text). Turns are numbered by the log's own turn column.
Null conv_id forms a conversation of its own. Extra columns are left out. An empty log gives no rows.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template. Roles are escaped as texts are, and a colon in them is written \\c.
OPEN, AFTER_ROLE, CLOSE = "### ", ": ", " </turn>\n"
#: No control string can be in a text in which # and < are written so.
ESCAPES = (("\\", "\\\\"), ("#", "\\h"), ("<", "\\l"))
_BACK = {"\\\\": "\\", "\\h": "#", "\\l": "<", "\\c": ":"}


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\[\\hlc]", lambda m: _BACK[m[0]], text)


def as_log(conversations: DataFrame) -> DataFrame:
    """A finished table of turns as a log with one ``message`` event for each row; repeated rows are turns of their own."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")).cast("long")
    return conversations.select("conv_id", place.alias("seq"), F.lit("message").alias("kind"), place.alias("turn"), "role", "text")


def streamed_log(conversations: DataFrame) -> DataFrame:
    """The log of a service that streamed these turns: what an assistant says is drafted, asked about too early, and regenerated in
    three deltas; what others say is sent by half and then edited. Folding gives the turns as they are.

    The turn that was sent before the regeneration is ended by it; the one that takes its place comes later.
    """
    turns = as_log(conversations).select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    n = F.char_length("text")
    part = lambda k: F.col("text").substr((F.floor(n * k / 3) + 1).cast("int"), (F.floor(n * (k + 1) / 3) - F.floor(n * k / 3)).cast("int"))
    half = F.col("text").substr(F.lit(1), F.floor(n / 2).cast("int"))
    event = lambda kind, turn, role, text: F.struct(F.lit(kind).alias("kind"), turn.alias("turn"), role.cast("string").alias("role"), text.alias("text"))
    turn, role, none = F.col("turn"), F.col("role"), F.lit(None)
    answer = F.array(
        event("message", turn, role, half), event("message", turn + 1, F.lit("user"), F.lit("too early")), event("regenerate", turn, role, part(0)), event("delta", turn, none, part(1)), event("delta", turn, none, part(2))
    )
    said = F.array(event("message", turn, role, half), event("edit", turn, none, F.col("text")))
    each = turns.select("conv_id", F.col("turn").alias("place"), F.posexplode(F.when(role == "assistant", answer).otherwise(said)).alias("k", "e"))
    return each.select("conv_id", (F.col("place") * 8 + F.col("k")).alias("seq"), "e.kind", "e.turn", "e.role", "e.text")


def fold(log: DataFrame) -> DataFrame:
    """Final messages: conv_id, turn, role, text."""
    events = log.select(
        "conv_id", F.col("seq").cast("long").alias("seq"), "kind", F.col("turn").cast("long").alias("turn"), "role",
        F.coalesce("text", F.lit("")).alias("text"),
    )
    # turns that a later regenerate ends: it is the smallest such turn that counts
    regenerated = F.min(F.when(F.col("kind") == "regenerate", F.col("turn")))
    later = Window.partitionBy("conv_id").orderBy(F.col("seq").desc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    live = events.withColumn("ended_from", regenerated.over(later)).filter("ended_from IS NULL OR turn <= ended_from")
    order = [F.col("seq").asc_nulls_first(), F.col("kind"), F.col("text")]
    turn = Window.partitionBy("conv_id", "turn").orderBy(*order)
    resets = F.col("kind").isin("message", "edit", "regenerate", "delete").cast("int")
    numbered = live.withColumn("place", F.row_number().over(turn)).withColumn("version", F.sum(resets).over(turn))
    per_version = numbered.groupBy("conv_id", "turn", "version").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda e: e["text"]), "").alias("text"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("place"))).alias("role"),
        F.max((F.col("kind") == "delete").cast("int")).alias("gone"),
    )
    last = per_version.groupBy("conv_id", "turn").agg(
        F.max_by(F.struct("text", "gone"), "version").alias("final"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("version"))).alias("role"),
    )
    return last.filter("final.gone = 0").select("conv_id", "turn", "role", F.col("final.text").alias("text"))


def render(messages: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One part per turn: conv_id, turn, part (formatted text), mask_start, mask_end (its code points to learn from).

    Joined in turn order, the parts of a conversation are its formatted text. Masks are null where nothing is learnt.
    """
    body = escape(F.coalesce("text", F.lit("")))
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit(":"), F.lit("\\c"))
    head = F.concat(F.lit(OPEN), role, F.lit(AFTER_ROLE))
    learnt = F.col("role").isin(*learn)
    return messages.select(
        "conv_id",
        "turn",
        F.concat(head, body, F.lit(CLOSE)).alias("part"),
        F.when(learnt, F.char_length(head)).alias("mask_start"),
        F.when(learnt, F.char_length(head) + F.char_length(body)).alias("mask_end"),
    )


def read_part(part: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if not part.startswith(OPEN) or not part.endswith(CLOSE):
        raise ValueError("not a formatted turn")
    role, text = part[len(OPEN) : -len(CLOSE)].split(AFTER_ROLE, 1)
    return unescape(role), unescape(text)


def summarize(parts: DataFrame) -> DataFrame:
    """Per conversation, from its formatted parts alone: turn and loss digests and sizes.

    Rows are dealt by conversation, sorted by turn and read as a stream; only running hashes are held.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        done: list[tuple] = []
        current, state = None, None

        def close() -> None:
            if state is not None:
                done.append((current[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def out() -> pa.RecordBatch:
            columns = zip(*done, strict=True) if done else [[]] * len(names)
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))
            done.clear()
            return made

        for batch in batches:
            for conv_id, part, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "mask_start", "mask_end")), strict=True):
                if current is None or current[0] != conv_id:
                    close()
                    current, state = (conv_id,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_part(part)
                state[0] += 1
                state[1].update(codecs.encode(f"{role}\n{text}\n", "utf-8"))
                if a is not None:
                    learnt = unescape(part[a:b])
                    state[2] += len(learnt)
                    state[3].update(codecs.encode(learnt, "utf-8"))
                state[4] += len(part)
            if done:
                yield out()
        close()
        yield out()

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    dealt = parts.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "part", "mask_start", "mask_end")
    return dealt.repartition("conv_id").sortWithinPartitions("conv_id", "turn").mapInArrow(work, schema)
