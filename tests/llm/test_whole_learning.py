"""Language profiles and bounds come from every document that may be learned from."""

import random
from collections import Counter

from graphloom.llm import language_id


def test_profiles_count_every_document(spark):
    texts = [f"{chr(0x4E00 + i)} common {'ab' * (i % 3)}" for i in range(6_000)]
    docs = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    want = Counter()
    for t in texts:
        want.update(language_id.gram_counts(t))
    assert language_id.learn(docs, size=100_000) == {"xx": sorted(want, key=lambda g: (-want[g], g))}


def test_counts_of_many_texts_are_sums(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(language_id, "BLOCK", 7)
    for dense in (0, 50, 4 << 20):
        monkeypatch.setattr(language_id, "DENSE", dense)
        for _ in range(300):
            texts = ["".join(rng.choice("abA _Σσς.İ1²é日½ſª한\n") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 4))]
            want = Counter()
            for t in texts:
                want.update(language_id.gram_counts(t))
            assert language_id.counts_together(texts) == want


def test_bounds_are_medians_of_all_rows(spark):
    rng = random.Random(4)
    scores = {k: [rng.random() for _ in range(n)] for k, n in (("de", 1), ("en", 5_000), ("fr", 5_001), ("und", 50))}
    scored = spark.createDataFrame([(k, s) for k, own in scores.items() for s in own], "lang_pred string, score double")
    want = {k: language_id.FIT * sorted(int(s * 10_000) for s in own)[(len(own) - 1) // 2] / 10_000 for k, own in scores.items() if k != "und"}
    for parts in (1, 3, 7):
        assert language_id.bounds(scored.repartition(parts)) == want


def test_every_labelled_document_sets_the_bounds(spark, sf, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang = 'en'")
    counted, own = [], language_id.bounds
    monkeypatch.setattr(language_id, "bounds", lambda scored, *more: (counted.append(scored.count()), own(scored, *more))[1])
    language_id.recognised(docs)
    assert counted == [docs.where(language_id.learning_part()).count()]
