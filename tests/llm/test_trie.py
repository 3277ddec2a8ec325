import hashlib
import re
import zlib

import duckdb
import pytest

from hearsay.llm import oracle, queries, trie
from verify_queries import plain

SF = "/root/testdata/sf0.001"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(convs):
    """convs: conv_id -> list of (role, text)."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes)]
        words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        ends = sorted(c for c in members if len(convs[c]) == len(path))
        out.append((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), sum(len(p) == len(path) + 1 for p in below), len(leaves),
            sum((len(nodes[p]) - 1) * words(p) for p in below), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def table(spark, convs, clash=False):
    rows = [(c, k, r, t, "x", "y") for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string, depth string")


def result(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=str)


def made(n):
    """Conversations that share beginnings, some of them ending in the middle of others."""
    out = {}
    for c in range(n):
        kind = zlib.crc32(b"%d" % c)
        length = kind % 6 + 1
        out[c * 3 - 20] = [("user" if k % 2 == 0 else "assistant", f"turn {k} of kind {kind % (k + 2)}") for k in range(length)]
    return out


@pytest.mark.parametrize(("shard", "width"), [(2048, 64), (7, 2), (3, 1)])
def test_trie_equals_brute_force(spark, monkeypatch, shard, width):
    """The whole operator; and, with small shards and narrow slices that meet all seams, the search itself in this process."""
    convs = made(150)
    convs[10_000] = [("user", "turn 0 of kind 0")] + [("assistant", f"long {k % 5}") for k in range(200)]
    convs[10_001] = convs[10_000][:130]
    convs[10_002] = convs[10_000]
    shards = trie._Shards
    for name, value in (("SHARD", shard), ("WIDTH", width)):
        monkeypatch.setattr(trie, name, value)
    rows = trie.numbered(trie.turns(table(spark, convs)))
    if (shard, width) == (2048, 64):
        assert result(trie.trie(rows)) == brute(convs)
        return
    seen = shards(0)
    for r in sorted(rows.filter("depth = 0").collect(), key=lambda r: r.conv_id):
        seen.ids.append(r.conv_id)
        seen.lengths.append(r.words)
    seen.begin()
    place = {c: i for i, c in enumerate(seen.ids)}
    tasks = {}
    for r in rows.filter("depth > 0").collect():
        tasks.setdefault(((r.depth - 1) // width, place[r.conv_id] // shard), []).append((place[r.conv_id] % shard, r.depth, bytes(r.key), r.words))
    for low, number in sorted(tasks):
        seen.work(number, low * width, tasks[low, number])
    assert not any(seen.open.values())
    members = {}
    for row in seen.out:
        if row[0] == 0:
            members[row[1]] = members.get(row[1], 0) + row[4]
    assert sorted(members.values()) == sorted(r[3] for r in brute(convs))
    ranks = sorted((row[7], row[8]) for row in seen.out if row[0] == 1)
    assert len(ranks) == len(set(ranks)) == len(convs)


def test_rebuilt_conversations(spark):
    convs = {}
    for c in [*range(0, 45), 61, 62, 80, 81, 82, 83, 84, 101, 102, 103, 104, 105, 106, 107, -3, -20, -40, -41]:
        convs[c] = [("user" if k % 2 == 0 else "assistant", f"{c if k > c % 3 else 'all'} {k}") for k in range(1 if c > 100 else abs(c) % 7 + 1)]
    want = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        want[c] = convs.get(base, [])[:h] + own[h:]
    assert result(trie.trie(trie.rebuilt(trie.turns(table(spark, convs))))) == brute(want)
    assert any(not v for v in want.values())  # a conversation without turns


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, 5, "user", "é " * 100_000), (2, None, "", ""), (2, 5, "user", "é " * 100_000), (3, 1, "a", "bc"), (4, 1, "ab", "c"),
        (5, 1, "user", "same"), (5, 1, "user", "same"), (None, 1, "user", "no id"), (6, 1, "user", "same"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    long = ("user", "é " * 100_000)
    same = ("user", "same")
    want = {1: [("", ""), long], 2: [("", ""), long], 3: [("a", "bc")], 4: [("ab", "c")], 5: [same, same], 6: [same]}
    assert result(trie.trie(trie.numbered(trie.turns(df)))) == brute(want)
    for start in (trie.numbered, trie.rebuilt):
        assert trie.trie(start(trie.turns(df.limit(0)))).collect() == []


def test_query_beside_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    cursor = db.execute(oracle.TRIE)
    names = [d[0] for d in cursor.description]
    rows = queries.op13_trie(spark, SF).collect()
    assert sorted(tuple(plain(r[c]) for c in names) for r in rows) == sorted(tuple(map(plain, r)) for r in cursor.fetchall())
