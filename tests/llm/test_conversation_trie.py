"""The conversation trie against a plain one built turn by turn."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from graphloom.llm import conversation_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, key string, n long"


def ordered(rows):
    own = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            own[r[0]].append(r)
    rank = lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())
    return {c: [(r[2] or "", r[3] or "") for r in sorted(v, key=rank)] for c, v in own.items()}


def spliced(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = set()
    for node, own in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = lambda x: [y for y in members if len(y) == len(x) + 1 and y[: len(x)] == x]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(own), len(node), parent, len(own), len(kids(node)), sum(not kids(x) for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def got(df):
    found = [tuple(r) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def conversations(n, seed=1):
    draw, rows = random.Random(seed), []
    for c in range(n):
        for k in range(draw.choice([1, 2, 3, 5, 9, 14])):
            rows.append((c, k, draw.choice(["user", "assistant", None]), draw.choice(["a", "b", "é" * 9, "", None]), "x", c))
    rows += [(0, None, "user", "first", "x", 1), (3, 1, "user", "a", "x", 1), (3, 1, "user", "a", "x", 1), (None, 0, "user", "a", "x", 1), (-3, 0, None, None, None, None), (10_000_000_007, 5, "user", "a", "x", 1)]
    return rows


def test_nodes_of_all_conversations(spark, sf):
    rows = [tuple(r) + (None, None) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op12_conversation_trie(spark, sf)) == brute(spliced(ordered(rows)))


@pytest.mark.parametrize("piece", [1, 1 << 16])
def test_odd_conversations(spark, monkeypatch, piece):
    monkeypatch.setattr(conversation_trie, "PIECE", piece)
    rows = conversations(40)
    own = spark.createDataFrame(rows, SCHEMA).repartition(3)
    turns = conversation_trie.turns_of(own)
    assert got(conversation_trie.trie(turns)) == brute(ordered(rows))


def test_shared_start_beyond_what_is_there(spark):
    rows = [r for r in conversations(12, 5) if r[0] is None or r[0] >= 0]
    turns = conversation_trie.turns_of(spark.createDataFrame(rows, SCHEMA))
    convs = ordered(rows)
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in convs}
    source = spark.createDataFrame([(c, c - c % 5, h[c]) for c in convs], "conv_id long, start long, h long")
    assert got(conversation_trie.trie(*conversation_trie.shared_start(turns, source))) == brute(spliced(convs))


def test_long_and_hot_conversations(spark):
    """One conversation holds a third of all rows, a third of all conversations are one text, and ranges cut through both."""
    rows = [(0, k, "user", f"t{k % 7}", "x", 1) for k in range(300)] + [(c, k, "user", f"t{k % 7}", "x", 1) for c in range(1, 60) for k in range(5)] + [(c, 0, "user", f"only {c}", "x", 1) for c in range(60, 120)]
    turns = conversation_trie.turns_of(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert got(conversation_trie.trie(turns)) == brute(ordered(rows))


def test_repeated_rows_and_none(spark):
    rows = [(1, 2, "user", "same", "x", 1)] * 50 + [(2, 2, "user", "same", "x", 1)]
    assert got(conversation_trie.trie(conversation_trie.turns_of(spark.createDataFrame(rows, SCHEMA)))) == brute(ordered(rows))
    assert got(conversation_trie.trie(conversation_trie.turns_of(spark.createDataFrame([], SCHEMA)))) == set()
