"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import lexical_search, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute(docs, items, k=10):
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n_docs, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, want in asked.items():
        scored = []
        for i, c in own:
            m = 10 + (90 * sum(c.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in want if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def found(df):
    return Counter(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def frame(spark, rows, *names):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], f"{names[0]} long, {names[1]} string, term string, score long").repartition(3)


def test_all_items_over_all_documents(spark, sf):
    read = lambda name, i: [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(i, "text").collect()]
    assert found(queries.op13_lexical_search(spark, sf)) == brute(read("documents", "doc_id"), read("benchmark", "item_id"))


@pytest.mark.parametrize(("run", "front", "docs_a_block", "pairs"), [(1, 1, 7, 5), (2, 3, 50, 1_000), (16, 64, 1 << 15, 40)])
def test_random_documents_with_ties(spark, monkeypatch, run, front, docs_a_block, pairs):
    """Blocks, fronts, runs and groups of any size give the same; a third of the documents are copies."""
    monkeypatch.setattr(lexical_search, "RUN", run)
    monkeypatch.setattr(lexical_search, "FRONT", front)
    monkeypatch.setattr(lexical_search, "DOCUMENTS", docs_a_block)
    draw = random.Random(run)
    word = lambda: f"w{int(draw.paretovariate(0.7)) % 60}"
    docs = [(k, " ".join(word() for _ in range(draw.randint(0, 30)))) for k in range(200)] + [(1000 + k, "w1 W2 w3 é") for k in range(100)]
    docs += [(None, "w1 w2"), (None, None), (5, "w9 w9 w9"), (5, "w9 w9 w9"), (-4, "É w2"), (7, "w1 " * 4000)]
    items = [(k, " ".join(word() for _ in range(draw.randint(0, 12)))) for k in range(12)] + [(3, "w2 w2 é"), (None, "w1"), (None, "w9"), (77, None), (78, "nowhere"), (79, "w1")]
    assert found(lexical_search.ranked(frame(spark, docs, "doc_id", "text"), frame(spark, items, "item_id", "text"), pairs=pairs)) == brute(docs, items)


def test_odd_texts(spark, odd):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    items = [(k, t) for k, (_, t) in enumerate(docs)]
    assert found(lexical_search.ranked(odd, frame(spark, items, "item_id", "text"), k=3)) == brute(docs, items, 3)


def test_nothing(spark, odd, none):
    nothing = frame(spark, [], "item_id", "text") if False else spark.createDataFrame([], "item_id long, text string")
    some = frame(spark, [(1, "same text")], "item_id", "text")
    assert found(lexical_search.ranked(odd, nothing)) == found(lexical_search.ranked(none, some)) == Counter()
    assert lexical_search.ranked(odd, nothing).columns == ["item_id", "rank", "doc_id", "score"]


def test_subtrees_are_pruned_and_heaps_hold():
    """Nodes are topmost in their subtree; with one strong document, few others are scored."""
    draw = np.random.default_rng(1)
    owner = np.repeat(np.arange(3000), 3)
    term = np.tile(np.arange(3), 3000)
    impact = draw.integers(1, 50, 9000)
    impact[:30] = 1000
    index = lexical_search.Treaps(list(range(3000)), owner, term, impact, 3)
    for child in (index.left, index.right):
        inner = child[:-1] != index.none
        assert (index.heap[:-1][inner] >= index.heap[child[:-1][inner]]).all()
    assert (index.doc[:-1][index.left[:-1] != index.none] > index.doc[index.left[:-1][index.left[:-1] != index.none]]).all()
    best, scored = lexical_search.Best(10), []
    exact = index.scores
    index.scores = lambda docs, wanted: scored.append(len(docs)) or exact(docs, wanted)
    index.search(np.arange(3), 10, best)
    assert [r[2] for r in best.rows] == list(range(10)) and sum(scored) < 600
