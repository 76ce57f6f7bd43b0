"""Ids of texts by way of chunks: what is looked up, made and forgotten."""

import random

from graphloom.llm import packing, queries

PATH = queries.tokenizer("word_bpe_49k.json")


def by_library(texts):
    return [packing._bytes(e.ids) for e in packing._tokenizer(PATH).encode_batch(texts, add_special_tokens=False)]


def test_plain_words_are_not_scanned(monkeypatch):
    class Scans:
        findall = search = staticmethod(lambda text: 1 / 0)

    texts = ["Plain words, twice plain words. THE END", "another, plain. end"]
    chunks = packing.ChunkIds(PATH)
    monkeypatch.setattr(packing, "PRETOKEN", Scans)
    assert chunks.ids([t.encode() for t in texts]) == by_library(texts)


def test_ids_with_small_memories():
    rng = random.Random(1)
    parts = [*"abAEÉéßẞİıǆªº²½'s.,!_ -12٣日ﬁ́\xad​<|>\n", "'s", "'ll", "word", "<|endoftext|>", "x" * 70, "é" * 200, "." * 300]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(5_000)]
    chunks = packing.ChunkIds(PATH)
    chunks.chunks.size = chunks.words.size = 50
    got = [ids for k in range(0, len(texts), 20) for ids in chunks.ids([t.encode() for t in texts[k : k + 20]])]
    assert got == by_library(texts)
    assert all(len(c) <= 4 * packing.LONG for c in chunks.chunks.now)
