"""Resolution by a judge: pairs proposed by q-grams against all pairs."""

import random
import re
import time
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import graphloom as g
from graphloom.operators import candidates
from graphloom.operators.candidates import similar_pairs
from graphloom.operators.resolution import clusters


def plain(name):
    skip = "inc ltd llc corp co company gmbh plc sa ag srl bv dr mr mrs ms prof mme m the".split()
    return " ".join(w for w in re.sub(r"[^\w\s]", " ", name.lower()).split() if w not in skip) or name.lower()


def gram_set(name):
    text = "\x02\x02" + plain(name) + "\x03\x03"
    return {text[i : i + 3] for i in range(len(text) - 2)}


def names(n, seed=3):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdeilmnorstuv") for _ in range(draw.randint(2, 9))) for _ in range(max(40, n // 4))]
    out = []
    for _ in range(n):
        name = " ".join(draw.choice(words) for _ in range(draw.randint(1, 3)))
        if draw.random() < 0.4:
            at = draw.randrange(len(name))
            name = name[:at] + draw.choice("xyz-") + name[at + 1 :]
        out.append(name if draw.random() < 0.8 else name.title() + " Ltd.")
    return out


@pytest.mark.parametrize("similarity", [0.3, 0.5, 0.8, 1.0])
def test_similar_pairs_are_all_pairs(spark, similarity):
    own = sorted({*names(120), "", ".", "The", "é", "a", "aa"})
    blocks = spark.createDataFrame([(k, n) for k in ("x", "y") for n in own] + [("x", None)], "block string, value string").repartition(3)
    jaccard = lambda a, b: len(gram_set(a) & gram_set(b)) / len(gram_set(a) | gram_set(b))
    want = sorted((k, a, b) for k in ("x", "y") for a, b in combinations(own, 2) if jaccard(a, b) >= similarity - 1e-9)
    assert sorted(tuple(r) for r in similar_pairs(blocks, similarity).collect()) == want


def test_pairs_grow_with_matches(spark):
    """40,000 names in pairs of spellings: as many pairs are made, not 800 million."""
    n = 20_000
    digits = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 14), 16, 36)
    own = spark.range(n).select(F.lit("b").alias("block"), F.concat(digits, F.lit(" lane")).alias("a"))
    both = own.select("block", F.col("a").alias("value")).unionByName(own.select("block", F.concat(F.col("a"), F.lit("s")).alias("value")))
    found = similar_pairs(both, 0.7)
    joined = found.where(F.concat("a", F.lit("s")) == F.col("b")).count()
    assert joined == n and found.count() < 1.05 * n


@pytest.mark.parametrize(("tile", "short"), [(16, 64), (40, 20), (8_192, 0)])
def test_lists_split_into_tiles(spark, monkeypatch, tile, short):
    """The same pairs where lists are dealt out by tiles, and where long texts go without their q-grams."""
    monkeypatch.setattr(candidates, "TILE", tile)
    monkeypatch.setattr(candidates, "SHORT", short)
    own = names(400, 5)
    want = sorted((a, b) for a, b in combinations(sorted({*own, "  - "}), 2) if len(gram_set(a) & gram_set(b)) >= 0.4 * len(gram_set(a) | gram_set(b)) - 1e-9)
    got = similar_pairs(spark.createDataFrame([("x", n) for n in {*own, "  - "}], "block string, value string"), 0.4)
    assert sorted((r["a"], r["b"]) for r in got.collect()) == want and len(want) > 100


def test_names_of_few_syllables(spark):
    """20,000 names that share most q-grams: 200 million pairs are looked at in batches, none by a join of its own."""
    syllable = lambda k: F.element_at(F.array(*map(F.lit, "ta ren shi no lum ver ka del ost in".split())), (F.conv(F.substring(F.md5(F.col("id").cast("string")), k, 2), 16, 10).cast("int") % 10 + 1))
    values = spark.range(20_000).select(F.lit("x").alias("block"), F.concat_ws("", *(F.concat(syllable(k), F.lit(" ")) if k % 6 == 5 else syllable(k) for k in range(1, 17, 2))).alias("value")).distinct()
    began = time.perf_counter()
    assert similar_pairs(values, 0.5).count() > 5_000 and time.perf_counter() - began < 120


def nodes(spark, rows):
    from graphloom.graph import NODES, attribute_map

    return spark.createDataFrame([(i, list(t), attribute_map({} if v is None else {"name": v})) for i, t, v in rows], NODES)


@pytest.mark.parametrize("keyed", [False, True])
def test_proposed_pairs_give_the_clusters_of_all_pairs(spark, keyed):
    def judge(a, b):
        bare = lambda x: "".join(sorted(c for c in x.lower().replace(" ltd.", "") if c not in "xyz- "))
        return bare(a) == bare(b)

    def resolver(similarity):
        own = g.LLMResolver(judge, similarity=similarity)
        return g.CascadeResolver([g.NormalizeResolver(), own]) if keyed else own

    own = names(60, 9)
    rows = [(f"n{k:03d}", ("t",) if k % 3 else ("u",), v) for k, v in enumerate([*own, *own[:20], "", "", None, None])]
    got = [sorted((r["id"], r["cid"]) for r in clusters(nodes(spark, rows), resolver(s)).collect()) for s in (None, 0.3)]
    assert got[0] == got[1] and len({c for _, c in got[0]}) < len(rows)


def test_copies_follow_the_judge(spark):
    """A judge that denies that a name is itself leaves its copies apart, unless it joins the name with another."""
    rows = [(f"n{k}", ("t",), v) for k, v in enumerate(["odd", "odd", "ring road", "ring road", "ring roads", "lone"])]
    got = {r["id"]: r["cid"] for r in clusters(nodes(spark, rows), g.LLMResolver(lambda a, b: a != b and a[:4] == b[:4], similarity=0.5)).collect()}
    assert got == {"n0": "n0", "n1": "n1", "n2": "n2", "n3": "n2", "n4": "n2", "n5": "n5"}


def test_other_spacing_is_asked_about(spark):
    """Names of the same letters meet however their spaces and punctuation change their q-grams, each pair once."""
    spelled = ["Ci nci n Que", "Ci n ci nque", "CI - N - CI - NQUE", "The The", "THE - THE", "c", "d++", "...", "- -"]
    values = spark.createDataFrame([("b", v) for v in spelled], "block string, value string")
    same = lambda v: re.sub("[- ]", "", v.lower()) or v
    asked = [(r["a"], r["b"]) for r in g.LLMResolver(None, similarity=0.8).questions(values).collect()]
    assert sorted(asked) == sorted((a, b) for a in spelled for b in spelled if a < b and same(a) == same(b))
    found = clusters(nodes(spark, [(f"n{k}", ("t",), v) for k, v in enumerate(spelled)]), g.LLMResolver(lambda a, b: same(a) == same(b), similarity=0.8))
    assert {r["id"]: r["cid"] for r in found.collect()} == dict(zip([f"n{k}" for k in range(9)], ["n0"] * 3 + ["n3"] * 2 + ["n5", "n6", "n7", "n8"], strict=True))


def test_similarity_is_checked(spark):
    with pytest.raises(ValueError, match="similarity"):
        similar_pairs(spark.createDataFrame([], "block string, value string"), 0)
