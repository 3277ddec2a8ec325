"""The prefix trie of conversations: every distinct sequence of first turns is a node (operator 13).

Method: vertical bitmaps. Conversations are dealt into shards of SHARD consecutive ids; in a shard, each (position, turn) has the
bitset of the conversations that have that turn there. From the root, depth first, a node's bitset is intersected with the
postings of the next position, beginning with that of its lowest member, until no member is left: each intersection is a child,
popcounts give the number of its members, and the bitset of conversations that end there its end list.

A turn is known by 16 bytes of the sha256 of its role and text, a node by 16 bytes of the sha256 of its parent and its turn, so the
nodes of all shards meet by key, with counts added up and the smallest member kept: the node's owner. A shard works on WIDTH
positions of all its conversations at a time and then only keeps its open nodes, so its memory doesn't grow with the longest
conversation.

Sums over subtrees need no walk. A node that one conversation has alone is known to be a chain with it: it has one leaf and saves
nothing. The others are shared. Each shared node's saving is booked to its owner, each leaf to the conversation that ends there;
a node's members are an interval of the shard's order (the order in which the search leaves them behind), so the bookings of its
members are one difference of prefix sums. What its owner has booked for nodes above it is taken off again.

End lists are texts for each node and shard; those of a node are hashed in the order of shards, as a stream.

Edge cases: a null role or text is empty; a conversation without turns is a member of the root alone, where its row has a null
turn; rows of a null conv_id are left out; equal rows are turns of their own, in the order of their turn, then of their digest;
texts are hashed whole in the JVM and go no further; extra columns are left out; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.llm import shared

SHARD, WIDTH = 2048, 64
ROOT = bytes(16)
#: kind 0: a node in a shard (its members are those of rank lo to lo + n); kind 1: a conversation and its rank.
_LOCAL = "kind int, key binary, parent binary, depth long, n long, conv_id long, words long, shard long, lo long, ends string"
_ARROW = pa.schema([
    ("kind", pa.int32()), ("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("n", pa.int64()),
    ("conv_id", pa.int64()), ("words", pa.int64()), ("shard", pa.int64()), ("lo", pa.int64()), ("ends", pa.string()),
])


def turn_key(role: str, text: str) -> Column:
    """16 bytes for a turn; the length of the role tells it from the text."""
    r, t = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.substring(F.unhex(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t), 256)), 1, 16)


def word_count(text: str) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text: the places where one begins."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, key, words of conversations (conv_id, turn, role, text)."""
    rows = conversations.filter("conv_id IS NOT NULL")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_key("role", "text").alias("key"), word_count("text").alias("words"))


def numbered(rows: DataFrame) -> DataFrame:
    """The rows that trie() takes, of turns(): depth from 1, and a row of depth 0 for each conversation, whose words are its number of turns."""
    conv = Window.partitionBy("conv_id")
    placed = rows.withColumn("depth", F.row_number().over(conv.orderBy(F.col("turn").asc_nulls_first(), "key")).cast("long")).withColumn("n", F.count("*").over(conv))
    own = F.struct("conv_id", "depth", "key", "words")
    start = F.struct("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("key"), F.col("n").alias("words"))
    return placed.select(F.inline(F.when(F.col("depth") == 1, F.array(own, start)).otherwise(F.array(own))))


def rebuilt(rows: DataFrame, block: int = 20, most: int = 4) -> DataFrame:
    """As numbered(), but a conversation c begins with the first h turns of conversation c - c % block (those that it has), followed
    by its own turns after its first h; h is crc32(c) % most. A block is one key: it has few conversations."""
    first = F.col("conv_id") - F.col("conv_id") % block
    dealt = rows.withColumn("block", first).repartition("block")
    conv, whole = Window.partitionBy("block", "conv_id"), Window.partitionBy("block")
    taken = lambda c: F.crc32(c.cast("string")) % most
    placed = dealt.withColumn("place", F.row_number().over(conv.orderBy(F.col("turn").asc_nulls_first(), "key")).cast("long"))
    base = F.col("conv_id") == F.col("block")
    known = (
        placed.withColumn("n", F.max("place").over(conv))
        .withColumn("given", F.least(taken(F.col("conv_id")), F.coalesce(F.max(F.when(base, F.col("place"))).over(whole), F.lit(0))))
        .withColumn("members", F.collect_set(F.when(F.col("place") == 1, F.col("conv_id"))).over(whole))
    )
    h = taken(F.col("conv_id"))
    none = F.array().cast("array<struct<conv_id: bigint, depth: bigint, key: binary, words: bigint>>")
    row = lambda conv_id, depth, key, words: F.struct(conv_id.alias("conv_id"), depth.alias("depth"), key.alias("key"), words.alias("words"))
    place, key, words = F.col("place"), F.col("key"), F.col("words")
    own = F.when(place > h, F.array(row(F.col("conv_id"), F.col("given") + place - h, key, words))).otherwise(none)
    lent = F.transform(F.filter("members", lambda c: taken(c) >= place), lambda c: row(c, place, key, words))
    length = F.col("given") + F.greatest(F.col("n") - h, F.lit(0))
    start = F.when(place == 1, F.array(row(F.col("conv_id"), F.lit(0).cast("long"), F.lit(None).cast("binary"), length))).otherwise(none)
    return known.select(F.inline(F.concat(own, F.when(base & (place < most), lent).otherwise(none), start)))


def _bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


class _Shards:
    """The shards of a task's conversations, whose ids ascend."""

    def __init__(self, part: int):
        self.part = part
        self.ids: list[int] = []
        self.lengths: list[int] = []
        self.open: dict[int, list[tuple[int, bytes, int]]] = {}
        self.out: list[tuple] = []

    def ends(self, first: int, last: int, low: int, high: int) -> dict[int, int]:
        """Bitsets, by length, of conversations first to last whose lengths are from low to high."""
        found: dict[int, int] = {}
        for i in range(first, last):
            n = self.lengths[i]
            if low <= n <= high:
                found[n] = found.get(n, 0) | 1 << i - first
        return found

    def leave(self, shard: int, first: int, ended: int, lo: int) -> str | None:
        """Ranks for the conversations that end at a node, and its end list."""
        if not ended:
            return None
        names = [self.ids[first + b] for b in _bits(ended)]
        self.out += [(1, None, None, None, None, c, None, shard, lo + k, None) for k, c in enumerate(names)]
        return ",".join(map(str, names))

    def begin(self) -> None:
        """The root of each shard."""
        for number in range(-(-len(self.ids) // SHARD)):
            first, last = number * SHARD, min(len(self.ids), (number + 1) * SHARD)
            shard, everyone = self.part << 24 | number, (1 << last - first) - 1
            ended = self.ends(first, last, 0, 0).get(0, 0)
            self.out.append((0, ROOT, None, 0, last - first, self.ids[first], 0, shard, 0, self.leave(shard, first, ended, 0)))
            self.open[number] = [(everyone & ~ended, ROOT, ended.bit_count())]

    def work(self, number: int, low: int, rows: list[tuple[int, int, bytes, int]]) -> None:
        """WIDTH positions from ``low`` + 1 of a shard. rows: (conversation's place in the shard, depth, turn, words)."""
        first, last = number * SHARD, min(len(self.ids), (number + 1) * SHARD)
        shard, ids, out, high = self.part << 24 | number, self.ids, self.out, low + WIDTH
        postings: dict[tuple[int, bytes], int] = {}
        turn_of: dict[tuple[int, int], tuple[bytes, int]] = {}
        for place, depth, turn, words in rows:
            postings[depth, turn] = postings.get((depth, turn), 0) | 1 << place
            turn_of[place, depth] = (turn, words)
        ends, still = self.ends(first, last, low + 1, high), []
        stack = [(bits, key, lo, low) for bits, key, lo in reversed(self.open.pop(number, []))]
        while stack:
            bits, key, lo, depth = stack.pop()
            while bits:  # its members that go on
                lowest = (bits & -bits).bit_length() - 1
                turn, words = turn_of[lowest, depth + 1]
                child = bits & postings[depth + 1, turn]
                bits ^= child
                name, n = hashlib.sha256(key + turn).digest()[:16], child.bit_count()
                ended = child & ends.get(depth + 1, 0)
                out.append((0, name, key, depth + 1, n, ids[first + lowest], words, shard, lo, self.leave(shard, first, ended, lo)))
                rest = child ^ ended
                if rest and depth + 1 == high:
                    still.append((rest, name, lo + ended.bit_count()))
                elif rest:
                    stack.append((rest, name, lo + ended.bit_count(), depth + 1))
                lo += n
        if still:
            self.open[number] = still


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes and ranks of a task's shards. Rows come by (slice of positions, conv_id, depth), lengths of all conversations first."""
    shards = _Shards(TaskContext.get().partitionId())
    places: dict[int, int] = {}
    now: tuple[int, int] | None = None
    rows: list[tuple[int, int, bytes, int]] = []

    def made() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*shards.out, strict=True), _ARROW, strict=True)], schema=_ARROW)
        shards.out.clear()
        return batch

    for batch in batches:
        for conv, depth, turn, words in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "key", "words")), strict=True):
            if not depth:
                places[conv] = len(shards.ids)
                shards.ids.append(conv)
                shards.lengths.append(words)
                continue
            if now is None:
                shards.begin()
            at = places[conv]
            task = ((depth - 1) // WIDTH, at // SHARD)
            if task != now:
                if rows:
                    shards.work(now[1], now[0] * WIDTH, rows)
                now, rows = task, []
                if len(shards.out) >= 8192:
                    yield made()
            rows.append((at % SHARD, depth, turn, words))
    if now is None:
        shards.begin()
    if rows:
        shards.work(now[1], now[0] * WIDTH, rows)
    if shards.out:
        yield made()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, ends_sha256 from end lists that come by (key, shard)."""
    key, running, out = None, None, []
    for batch in batches:
        for k, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    out.append((key, running.hexdigest()))
                key, running = k, hashlib.sha256(ends.encode())
            else:
                running.update(b"," + ends.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["key", "ends_sha256"])
            out.clear()
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([running.hexdigest()])], names=["key", "ends_sha256"])


def _booked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, leaves, saved: sums of what the members of a shard's nodes have booked. Rows come by (shard, kind, lo): the
    conversations of a shard, by rank, then its nodes."""
    shard, leaves, saved, totals = None, [], [], None
    for batch in batches:
        out = []
        for s, kind, lo, n, key, leaf, save in zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "lo", "n", "key", "leaf", "save")), strict=True):
            if s != shard:
                shard, leaves, saved, totals = s, [0], [0], None
            if kind == 0:
                leaves.append(leaves[-1] + leaf)
                saved.append(saved[-1] + save)
            else:
                out.append((key, leaves[lo + n] - leaves[lo], saved[lo + n] - saved[lo]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["key", "leaves", "saved"])


def trie(rows: DataFrame) -> DataFrame:
    """Nodes: key, depth, conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    rows: conv_id, depth, key, words, as numbered() makes them.
    """
    order = [F.floor((F.col("depth") - 1) / WIDTH), F.col("conv_id"), F.col("depth")]
    dealt = rows.repartitionByRange("conv_id").sortWithinPartitions(*order)
    local = shared.written(dealt.mapInArrow(_search, _LOCAL), "trie-shards")
    same = Window.partitionBy("key")
    nodes = local.filter("kind = 0").withColumns({
        "n_convs": F.sum("n").over(same), "owner": F.min("conv_id").over(same),
        "one": F.row_number().over(same.orderBy("shard")) == 1, "ended": F.max(F.col("ends").isNotNull()).over(same),
    })
    nodes = shared.written(nodes.drop("kind"), "trie-nodes")
    merged = nodes.filter("one").select("key", "parent", "depth", F.col("owner").alias("conv_id"), "n_convs", "words", "ended", "ends")
    above = merged.filter("n_convs > 1").select(F.col("key").alias("parent"), F.col("conv_id").alias("_above"))
    placed = merged.join(above, "parent", "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("_above", "conv_id")).alias("parent_conv_id")
    # of one conversation alone: a chain
    alone = placed.filter("n_convs = 1").select(
        "key", "depth", "conv_id", parent, "n_convs", F.when(F.col("ended"), 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.sha2(F.coalesce("ends", F.lit("")), 256).alias("ends_sha256"),
    )
    children = placed.filter("_above IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    common = placed.filter("n_convs > 1").join(children, "key", "left").select(
        "key", "depth", "conv_id", parent, "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), ((F.col("n_convs") - 1) * F.col("words")).alias("save")
    )
    common = shared.written(common, "trie-shared")
    book = lambda df, leaf, save: df.select("conv_id", leaf.alias("leaf"), save.alias("save"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    booked = book(alone.filter("n_children = 0"), one, zero).unionAll(book(common, F.when(F.col("n_children") == 0, one).otherwise(zero), F.col("save")))
    booked = booked.groupBy("conv_id").agg(F.sum("leaf").alias("leaf"), F.sum("save").alias("save"))
    ranks = local.filter("kind = 1").select("conv_id", "shard", "lo").join(booked, "conv_id", "left")
    members = ranks.select("shard", F.lit(0).alias("kind"), "lo", zero.alias("n"), F.lit(None).cast("binary").alias("key"), F.coalesce("leaf", zero).alias("leaf"), F.coalesce("save", zero).alias("save"))
    asked = nodes.filter("n_convs > 1").select("shard", F.lit(1).alias("kind"), "lo", "n", "key", zero.alias("leaf"), zero.alias("save"))
    streamed = members.unionAll(asked).repartition("shard").sortWithinPartitions("shard", "kind", "lo")
    sums = streamed.mapInArrow(_booked, "key binary, leaves long, saved long").groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("booked"))
    lists = nodes.filter("n_convs > 1 AND ends IS NOT NULL").select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard")
    ends = lists.mapInArrow(_digests, "key binary, ends_sha256 string")
    earlier = F.coalesce(F.sum("save").over(Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), zero)
    whole = common.withColumn("_earlier", earlier).join(sums, "key").join(ends, "key", "left")
    done = whole.select(
        "key", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("booked") - F.col("_earlier")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
    return done.unionAll(alone)
