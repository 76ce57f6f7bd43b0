"""Operators that SQL cannot express, against brute force on whole small tables and odd texts."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from graphloom.llm import decontamination, exact_dedup, language_id, packing, queries, simhash, token_counts


def rows(df):
    return [r.asDict() for r in df.collect()]


def documents(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# token counts -----------------------------------------------------------------


def piece_model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))


def test_token_counts_of_all_documents(spark, sf):
    model, texts = piece_model(), documents(spark, sf)
    got = rows(queries.op10_token_counts(spark, sf))
    assert len(got) == len(texts)
    for r in got:
        n = len(model.encode(texts[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 4096)


@pytest.mark.parametrize("head", [0, 5, 300_000])
def test_token_counts_of_odd_texts(spark, odd, head):
    model = piece_model()
    got = rows(token_counts.token_counts(odd, queries.tokenizer("piece_bpe_32k.model"), head=head))
    want = [(r["doc_id"], len((r["text"] or "").encode()), len(model.encode(r["text"] or ""))) for r in odd.collect()]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r["id"], r["n_bytes"], r["n_tokens"]) for r in got), key=key) == sorted(want, key=key)


def test_token_counts_of_nothing(none):
    assert rows(token_counts.token_counts(none, queries.tokenizer("piece_bpe_32k.model"))) == []


# packing ----------------------------------------------------------------------


def token_ids(text):
    from tokenizers import Tokenizer

    token_ids.own = getattr(token_ids, "own", None) or Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    return [*token_ids.own.encode(text or "", add_special_tokens=False).ids, 1]


def check_packed(got, texts, capacity):
    by_sequence = defaultdict(list)
    by_doc = defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, text in texts.items():
        ids, own = token_ids(text), sorted(by_doc.pop(doc), key=lambda r: r["piece"])
        assert [r["start"] for r in own] == list(range(0, len(ids), capacity))
        for r in own:
            part = np.array(ids[r["start"] : r["start"] + capacity], "<u4").tobytes()
            assert (r["length"], r["ids_crc32"]) == (len(part) // 4, zlib.crc32(part))
    assert not by_doc
    return by_sequence


def test_packing_of_all_documents(spark, sf):
    texts = documents(spark, sf)
    got = rows(queries.op3_best_fit_packing(spark, sf))
    packed = check_packed(got, texts, 4096)
    assert len(packed) <= 1.03 * sum(len(token_ids(t)) for t in texts.values()) / 4096 + 1


def test_packing_of_odd_texts(spark, odd, none):
    path = queries.tokenizer("word_bpe_49k.json")
    once = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = [{**r, "doc_id": r["id"]} for r in rows(packing.pack(once, path, capacity=64, with_ids=True))]
    check_packed(got, {r["doc_id"]: r["text"] for r in once.collect()}, 64)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in got)
    assert len({r["row"] for r in rows(packing.pack(odd, path))}) == odd.count()
    assert rows(packing.pack(none, path)) == []


def test_plan_matches_item_by_item_packing():
    rng = np.random.default_rng(5)
    for capacity in (10, 37, 96):
        for n in (0, 1, 7, 400):
            lengths = rng.integers(1, capacity + 1, n)
            counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
            plan = packing.Plan(counts, capacity)
            bins = defaultdict(list)
            for length, runs in plan.runs.items():
                starts = [r[0] for r in runs]
                assert starts[0] == 0 and plan.placed[length] == counts[length]
                for (rank, first, each, offset), stop in zip(runs, [*starts[1:], counts[length]], strict=True):
                    for k in range(stop - rank):
                        bins[first + k // each].append((offset + k % each * length, length))
            for own in bins.values():
                own.sort()
                assert [o for o, _ in own] == [sum(x for _, x in own[:i]) for i in range(len(own))]
                assert sum(x for _, x in own) <= capacity and sum(3 * x > capacity for _, x in own) <= 2
            assert len(bins) == plan.sequences == reference_bins(list(lengths), capacity)


def reference_bins(lengths, capacity):
    """The method, one document at a time."""
    large, gaps = sorted(x for x in lengths if 3 * x > capacity), []
    while large:
        x = large.pop()
        fits = [y for y in large if x + y <= capacity]
        if fits:
            large.remove(max(fits))
        gaps.append(capacity - x - (max(fits) if fits else 0))
    for x in sorted((x for x in lengths if 3 * x <= capacity), reverse=True):
        fits = [g for g in gaps if g >= x]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - x)
        else:
            gaps.append(capacity - x)
    return len(gaps)


# exact dedup ------------------------------------------------------------------


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def check_exact(got, given):
    groups = defaultdict(list)
    for i, t in given:
        groups[ascii_lower(t)].append(i)
    assert len(got) == len(given)
    stay = defaultdict(int)
    for r in got:
        stay[r["text_sha256"]] += r["kept"]
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): own for t, own in groups.items()}
    assert stay == dict.fromkeys(by_sha, 1)
    for r in got:
        own = by_sha[r["text_sha256"]]
        keep = max((i for i in own if i is not None), default=None)
        assert (r["keep_id"], r["group_size"]) == (keep, len(own))
        assert r["id"] in own and (not r["kept"] or r["id"] == keep)


def test_exact_groups_of_odd_texts(spark, odd, none):
    check_exact(rows(exact_dedup.exact_groups(odd)), [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert rows(exact_dedup.exact_groups(none)) == []


def test_exact_groups_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "RUN_ROWS", 7)
    given = [(i, "hot Text" if i % 3 else f"text {i % 50}" + "z" * 60) for i in range(600)]
    check_exact(rows(exact_dedup.exact_groups(spark.createDataFrame(given, "doc_id long, text string").repartition(6))), given)


# SimHash ----------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(points, radius=3):
    """Smallest id reachable, for a list of (id, fingerprint)."""
    up = list(range(len(points)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if (points[i][1] ^ points[j][1]).bit_count() <= radius:
                up[find(i)] = find(j)
    low = {}
    for i, (own, _) in enumerate(points):
        low[find(i)] = min(low.get(find(i), own), own)
    return {own: low[find(i)] for i, (own, _) in enumerate(points)}


def test_simhash_of_all_documents(spark, sf, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 40)
    texts = documents(spark, sf)
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = plain_components(list(prints.items()))
    got = rows(queries.op5_simhash_near_dedup(spark, sf))
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}


def test_simhash_of_odd_texts(spark, odd, none):
    got = rows(simhash.near_duplicates(odd))
    assert len(got) == odd.count()
    for r in odd.where("doc_id is not null").collect():
        assert any(g["id"] == r["doc_id"] and g["fp"] % (1 << 64) == plain_fingerprint(r["text"]) for g in got)
    assert rows(simhash.near_duplicates(none)) == []


def test_links_and_components_of_planted_clusters(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 50)
    monkeypatch.setattr(simhash, "BLOCK", 1 << 10)
    rng = np.random.default_rng(3)
    points = set()
    for base in rng.integers(0, 1 << 63, 40, dtype=np.uint64).tolist():
        for _ in range(12):
            points.add(base)
            for bit in rng.integers(0, 64, rng.integers(1, 5)).tolist():
                base ^= 1 << bit
    points = sorted(points)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    found = {r["node"]: r["component"] for r in simhash.components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))).collect()}
    want = plain_components(list(zip(signed, points, strict=True)))
    assert {p: found.get(p, p) for p in signed} == want


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}


# decontamination --------------------------------------------------------------


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text)) if text else []


def plain_hits(text, items, window):
    own, hit, found = plain_words(text), set(), set()
    for i, item in items:
        words = plain_words(item)
        n = min(window, len(words))
        windows = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else ()
        for k in range(len(own) - n + 1 if n else 0):
            if tuple(own[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                found.add(i)
    return len(own), hit, found


def test_decontamination_of_all_documents(spark, sf):
    texts = documents(spark, sf)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r["doc_id"]: r for r in rows(queries.op6_benchmark_decontamination(spark, sf))}
    assert got.keys() == texts.keys() and any(r["contaminated"] for r in got.values())
    for i, text in texts.items():
        n, hit, found = plain_hits(text, items, 10)
        names = ",".join(sorted(map(str, found)))
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"], got[i]["contaminated"]) == (n, len(hit), len(found), bool(hit))
        assert got[i]["items_sha256"] == hashlib.sha256(names.encode()).hexdigest()


@pytest.mark.parametrize("limit", [1_000_000, 9])
@pytest.mark.parametrize("window", [1, 2, 3, 5])
def test_decontamination_of_random_words(spark, monkeypatch, window, limit):
    monkeypatch.setattr(decontamination, "SHARD_WORDS", limit)
    rng = np.random.default_rng(window)
    text = lambda n: " ".join(rng.choice(["a", "b", "C", "dé"], n))
    items = [(i, text(int(rng.integers(1, 9)))) for i in range(6)] + [(6, ""), (7, None), (8, "..."), (3, "b a b"), (None, "a")]
    docs = [(i, text(int(rng.integers(0, 40)))) for i in range(60)] + [(60, None), (61, "")]
    got = {r["id"]: r for r in rows(decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=window))}
    for i, t in docs:
        n, hit, found = plain_hits(t, [x for x in items if x[0] is not None], window)
        assert got[i]["n_words"] == n and set(got[i]["items"]) == found
        assert {k for s in got[i]["spans"] for k in range(s["start"], s["stop"])} == hit


def test_decontamination_of_nothing(spark, odd, none):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert all(r["spans"] == [] for r in rows(decontamination.contamination(odd, empty)))
    assert rows(decontamination.contamination(none, empty)) == []


def test_removal(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, "Keep this. " + item.title() + "! And " + "more words here " * 20, "x"), (2, item, "x"), (3, "clean  text\n", "x"), (4, None, "x")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["text"] for r in rows(decontamination.decontaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")))}
    assert got == {1: "Keep this. ! And " + "more words here " * 20, 3: "clean  text\n", 4: None}


# language ID ------------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = rows(queries.op7_language_id(spark, sf))
    assert {r["doc_id"] for r in got} == lang.keys()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def plain_nearest(text, profiles):
    counts = language_id.gram_counts(text or "")
    top = sorted(counts, key=lambda g: (-counts[g], language_id.code(g)))[: language_id.OWN]
    if not top:
        return "und", 0.0
    size = max(map(len, profiles.values()))
    apart = {k: sum(abs(p.index(g) - i) if g in p else size for i, g in enumerate(top)) for k, p in sorted(profiles.items())}
    best = min(apart, key=apart.get)
    return best, 1 - apart[best] / (size * len(top))


def test_language_by_brute_force(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    profiles = language_id.learn(docs)
    assert set(profiles) == {"de", "en", "es", "fr"} and all(len(p) == language_id.PROFILE for p in profiles.values())
    for given in (docs, odd):
        for r in rows(language_id.identify(given, profiles, ["doc_id", given["text"].alias("t")])):
            want = plain_nearest(r["t"], profiles)
            assert r["lang_pred"] == want[0] and abs(r["score"] - want[1]) < 1e-9
    assert rows(language_id.identify(none, profiles, ["doc_id"])) == []
    assert all(r["lang_pred"] == "und" for r in rows(language_id.identify(odd, {}, ["doc_id"])))
    assert language_id.learn(none.withColumnRenamed("row", "lang")) == {}


def test_unrecognised_documents_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = spark.createDataFrame([(-1, None, None, "s", 0), (-2, "123 !!", "en", "s", 6), (-3, "", None, None, 0)], docs.schema)
    got = language_id.recognised(docs.unionByName(more))
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect()} == {r["doc_id"] for r in docs.collect() if re.search(r"[^\W\d_]", r["text"])}
