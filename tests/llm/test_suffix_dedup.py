"""Repeated strings against a table of all windows."""

import hashlib
from collections import Counter

import numpy as np

from graphloom.llm import suffix_dedup


def plain(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
        kept = bytes(b for b, g in zip(d, gone.tolist(), strict=True) if not g)
        out.append((len(d), int(gone.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts):
    got = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert got == dict(enumerate(plain(texts)))
    return got


def test_planted_repeats(spark):
    rng = np.random.default_rng(1)
    word = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    shared = word(420)
    texts = [word(500) + shared[k : k + 200 + k] + word(300) for k in range(0, 160, 23)]
    texts += [word(900), word(700)] + [t := word(350), t, t + "x", "y" + t] + [word(100) + shared[:199] + word(100), None, "", "z" * 700, "ab" * 300, word(199), "q" * 200, "q" * 200 + "p"]
    got = check(spark, texts)
    assert any(0 < r[1] < r[0] for r in got.values())


def test_pieces_of_few_strings(spark):
    """Repeats that begin and end anywhere, next to one another, over ends of stretches and parts of stretches."""
    rng = np.random.default_rng(2)
    pool = ["".join(rng.choice(list("abcdé "), 600)) for _ in range(4)] + ["ab" * 300]
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rng.integers(1, 5)):
            a = rng.integers(0, 400)
            parts.append(pool[rng.integers(len(pool))][a : a + rng.integers(1, 420)])
        texts.append("".join(parts))
    got = check(spark, texts)
    assert sum(0 < r[1] < r[0] for r in got.values()) > 20


def test_all_documents(spark, sf):
    check(spark, [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()])


def test_nothing(spark, none):
    assert suffix_dedup.without_repeats(none).collect() == []


def test_odd_rows(spark, odd):
    """Null, repeated and clashing ids and columns: a row for each row, and repeated rows repeat each other."""
    rng = np.random.default_rng(5)
    long = "".join(rng.choice(list("abcdefgh "), 900))
    extra = [(None, long, "clash", 1), (None, long[:500], "clash", 1), (7, long[300:] + "x" * 30, None, 2), (7, None, None, 2)]
    docs = odd.unionByName(spark.createDataFrame(extra, odd.schema)).withColumns({"first": odd["n"], "text_": odd["text"]})
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted(map(repr, ((i, *p) for (i, _), p in zip(texts, plain([t for _, t in texts]), strict=True))))
    got = suffix_dedup.without_repeats(docs).select("id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(repr(tuple(r)) for r in got) == want


def test_long_texts_are_cut_into_blocks(spark):
    rng = np.random.default_rng(6)
    long = "".join(map(chr, rng.integers(97, 123, 3_000_000)))
    shared = [(10, 700), (suffix_dedup.BLOCK - 150, suffix_dedup.BLOCK + 90), (2 * suffix_dedup.BLOCK - 60_000, 2 * suffix_dedup.BLOCK + 60_000)]
    other = "".join("#" + long[a:b] + "!" for a, b in shared)
    got = {r["id"]: r for r in suffix_dedup.without_repeats(spark.createDataFrame([(1, long), (2, other)], "doc_id long, text string")).collect()}
    assert [(s["start"], s["stop"]) for s in got[1]["spans"]] == shared
    assert [s["stop"] - s["start"] for s in got[2]["spans"]] == [b - a for a, b in shared] and got[2]["n_bytes"] - got[2]["n_removed"] == 6


def test_order_and_hot_keys(spark):
    """Names follow the keys' order, and equal keys have one name however many ranges they fill."""
    from graphloom.llm.common import stored
    from graphloom.llm.ordering import ranked

    rows = [(7 if k % 3 else k, bytes([k % 5]), k) for k in range(4000)]
    made, _ = ranked(stored(spark.createDataFrame(rows, "a int, b binary, at long"), "keys"), ["a", "b"], ["at"], "ranks", ["b"], every=True)
    got = {r["at"]: r for r in made.collect()}
    keys = sorted({r[:2] for r in rows})
    names = sorted({r["name"] for r in got.values()})
    place, many = dict(zip(keys, names, strict=True)), Counter(r[:2] for r in rows)
    assert all(got[at]["name"] == place[a, b] and got[at]["shared"] == (many[a, b] > 1) for a, b, at in rows)
    leads = [r for r in got.values() if r["leads"]]
    assert len(leads) == len(keys) == len({r["name"] for r in leads}) and all(bytes(r["b"]) == rows[r["at"]][1] for r in leads)
    only, _ = ranked(stored(spark.createDataFrame(rows, "a int, b binary, at long"), "keys"), ["a", "b"], ["at"], "ranks")
    assert {r["at"]: r["name"] for r in only.collect()} == {at: r["name"] for at, r in got.items() if r["shared"]}
    parts = made.groupBy("name").count().orderBy("count", ascending=False).first()["count"]
    assert parts > 500
