"""Which documents the pipeline's language stage keeps."""

import numpy as np

from graphloom.llm import language_id


def test_texts_that_fit_no_profile_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = np.random.default_rng(1)
    junk = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(2, 10)))) for _ in range(n)) for n in (20, 100, 1000)]
    far = ["текст на русском языке", "日本語のテキスト 漢字かな交じり文", "zxqj kvwq xzzj", *junk]
    more = spark.createDataFrame([(-k, t, None, "s", len(t)) for k, t in enumerate(far, 1)], docs.schema)
    got = {r["doc_id"] for r in language_id.recognised(docs.unionByName(more)).collect()}
    assert got == {r["doc_id"] for r in docs.collect()}


def test_without_profiles_texts_with_letters_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    odd = spark.createDataFrame([(-1, "12 !", None, "s", 4), (-2, None, None, "s", 0), (-3, "текст", None, "s", 5)], docs.schema)
    for given in (docs.selectExpr("doc_id", "text", "cast(null as string) lang", "source", "n_chars"), docs.selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars")):
        got = [r["text"] for r in language_id.recognised(given.unionByName(odd)).collect()]
        assert sorted(got) == sorted([*(r["text"] for r in docs.collect()), "текст"])
