"""Language-model scores: counts by brute force, probabilities that add up, and held-out texts that become likelier."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import neural_lm, queries

SPACE = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    text = (text or "").translate(LOW)
    for s in SPACE[1:]:
        text = text.replace(s, " ")
    return [w for w in text.split(" ") if w]


def brute(docs):
    """id, held out, tokens, known ones, training tokens and base score of each row."""
    part = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 7
    counts, end = Counter(), 0
    for i, t in docs:
        if part(i) not in (None, 2):
            counts.update(words(t))
            end += 1
    total, distinct = sum(counts.values()) + end, len(counts) + bool(end)
    out = []
    for i, t in docs:
        own = words(t)
        known = [counts[w] for w in own] + [end]
        base = sum(math.log10((c + 1) / (total + distinct + 1)) for c in known)
        out.append((i, part(i) == 2, len(own) + 1, sum(c > 0 for c in known), total, base))
    return out


def held(rows):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    return sorted(rows, key=key)


def check(got, docs):
    want = held(brute(docs))
    own = held([(r["id"] if "id" in r else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got])
    assert [r[:5] for r in own] == [r[:5] for r in want]
    assert [r[5] for r in own] == pytest.approx([r[5] for r in want], rel=1e-9, abs=1e-9)


def scored(df, **more):
    left = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7))
    return [r.asDict() for r in neural_lm.scores(df, left != 2, left == 2, **more).collect()]


@pytest.fixture(scope="module")
def small(spark, sf):
    return [r.asDict() for r in queries.op11_lm_scoring(spark, sf).collect()]


def test_counts_of_all_documents(spark, sf, small):
    check(small, [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])


def test_held_out_texts_are_likelier_than_by_frequency(small):
    out = [r for r in small if r["held_out"] and r["n_tokens"] > 1]
    assert out and sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in small)


@pytest.mark.parametrize(("head", "n_words", "n_endings"), [(0, 2, 1), (5, 0, 0), (200_000, 1_024, 256)])
def test_odd_texts(spark, odd, head, n_words, n_endings):
    got = scored(odd, head=head, n_words=n_words, n_endings=n_endings)
    check(got, [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert all(math.isfinite(r["score"]) for r in got)


def test_the_head_changes_no_score(spark, odd):
    a, b = ({(r["id"], r["n_tokens"], r["n_known"]): r["score"] for r in scored(odd.coalesce(1), head=h)} for h in (0, 200_000))
    assert a == pytest.approx(b)


def test_nothing_and_nothing_to_learn_from(spark, none):
    assert scored(none) == []
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = scored(spark.createDataFrame([(only, "a b"), (None, None)], "doc_id long, text string"))
    check(got, [(only, "a b"), (None, None)])
    assert all(r["base_score"] == 0 and math.isfinite(r["score"]) for r in got)


def model(tokens, seed=3):
    own = neural_lm.Model(np.array(tokens))
    draw = np.random.default_rng(seed)
    return own.put(own.flat() + draw.normal(0, 0.3, own.flat().size))


def test_probabilities_add_up_and_follow_the_definition():
    own = model([5, 3, 0, 9, 1])
    one, two, z = own.tables()
    before, by_last, by_first, after, bias = (p.astype(float) for p in own.parts)
    for last in range(6):
        for first in range(6):
            s = after @ (before[last] @ by_last + before[first] @ by_first) + bias
            p = np.exp(s) / np.exp(s).sum()
            assert np.exp(one[last] + two[first] - z[last, first]) == pytest.approx(p)
            assert p.sum() == pytest.approx(1)


def test_words_of_a_unit_share_it():
    """Over all training words and one unseen word a unit, shares add up to 1."""
    counts = {b"aaa": 50, b"xing": 4, b"ying": 3, b"zed": 2, b"q": 1}
    held = neural_lm.Units([(b"aaa", 50)], [b"ing"], {b"ing": (7, 2), None: (3, 2)}, {}, 6)
    for unit, own in ((held.of(b"xing"), [4, 3]), (held.of(b"q"), [2, 1])):
        assert sum(10 ** (math.log10(n + 1) - held.share[unit]) for n in [*own, 0]) == pytest.approx(1)
    assert held.of(b"aaa") == 0 and held.share[0] == held.share[held.end] == 0 and held.of(b"zed") == held.rest
    assert len(counts) == 5


def test_gradient_is_that_of_the_objective():
    """Steps of noise-contrastive estimation on a chain of units bring its probabilities near those of the chain."""
    draw = np.random.default_rng(0)
    chain = np.array([[0.1, 0.8, 0.1], [0.1, 0.1, 0.8], [0.8, 0.1, 0.1]])
    own = [0]
    for _ in range(40_000):
        own.append(draw.choice(3, p=chain[own[-1]]))
    own = np.array(own)
    trainer = neural_lm.Trainer(neural_lm.Model(np.bincount(own), size=8), seed=1)
    for k in range(2, len(own) - 200, 200):
        at = np.arange(k, k + 200)
        trainer.step(own[at - 1], own[at - 2], own[at])
    one, two, z = trainer.model.tables()
    p = np.array([np.exp(one[a] + two[b] - z[a, b]) for a, b in [(0, 2), (1, 0), (2, 1)]])
    assert np.abs(p - chain).max() < 0.08
