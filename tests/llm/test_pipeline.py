"""The pipeline's stages against brute force, each on its own input."""

import re

import corpus_pipeline
from graphloom.llm import language_id, simhash
from test_text_ops import ascii_lower, check_packed, plain_components, plain_fingerprint, plain_hits


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10_000, None, "en", "s", 0), (10_001, "12 !", "en", "s", 4), (10_002, "ONE more", "en", "s", 8), (10_003, "one MORE", None, None, 8)], docs.schema)
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    leak = spark.createDataFrame([(10_004, item, "en", "s", len(item)), (10_005, "A text of other words. " * 30 + item + " And then more.", "en", "s", 1)], docs.schema)
    docs.unionByName(odd).unionByName(leak).write.parquet(f"{tmp_path}/in")
    now = spark.read.parquet(f"{tmp_path}/in")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in now.collect()}
        made = stage(spark, now, sf)
        if k < 4:
            assert made.schema.simpleString() == docs.schema.simpleString()
        made.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        rows = [r.asDict() for r in now.collect()]
        after = {r["doc_id"]: r for r in rows}
        texts = {i: r["text"] for i, r in before.items()}
        if name == "language ID":
            assert after.keys() == {i for i, t in texts.items() if re.search(r"[^\W\d_]", t or "")}
        elif name == "exact dedup":
            last = {}
            for i, t in texts.items():
                last[ascii_lower(t)] = max(i, last.get(ascii_lower(t), i))
            assert after.keys() == set(last.values())
        elif name == "SimHash near-dedup":
            assert after.keys() == set(plain_components([(i, plain_fingerprint(t)) for i, t in texts.items()]).values())
        elif name == "benchmark decontamination":
            assert 10_004 not in after and item not in after[10_005]["text"] and after[10_005]["n_chars"] == len(after[10_005]["text"])
            for i, t in texts.items():
                hit = plain_hits(t, items, 10)[1]
                if not hit:
                    assert after[i]["text"] == t
                elif i in after:
                    assert len(after[i]["text"]) < len(t)
            continue
        if k < 3:
            assert all(dict(after[i]) == before[i].asDict() for i in after)
    check_packed(rows, texts, 4096)


def test_run(spark, sf):
    made = corpus_pipeline.run(spark, sf)
    assert made.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and made.count() > 0
    assert language_id and simhash
