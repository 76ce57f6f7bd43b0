"""Hot keys, changed splits, clashing columns, and what the driver may see."""

import corpus_pipeline
import numpy as np
import pytest
from graphloom.llm import common, decontamination, exact_dedup, simhash
from pyspark.sql import functions as F
from test_text_ops import plain_hits, rows


def test_hot_keys_are_joined_like_others(spark):
    left = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(-1)).otherwise(F.col("id") % 1500).alias("k"), F.col("id").alias("v")).unionByName(spark.createDataFrame([(None, 1)], "k long, v long"))
    right = left.where("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        got = sorted(map(repr, common.hot_join(left, right, ["k"], "n", how).select("k", "v", "n").collect()))
        assert got == sorted(map(repr, left.join(right, "k", how).select("k", "v", "n").collect()))


@pytest.mark.parametrize("stage", [corpus_pipeline.exact, corpus_pipeline.near])
def test_a_changed_split_loses_nothing(spark, sf, tmp_path, stage):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("_row", F.col("doc_id") * 3).repartition(7)
    docs.write.parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = []
    try:
        for size in ("1000000", "30000", "7000"):
            made = stage(spark, spark.read.parquet(f"{tmp_path}/in"), sf)
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)  # between the plan and its run
            found.append(sorted(map(repr, made.collect())))
            assert made.columns == docs.columns
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found[0] == found[1] == found[2] and 0 < len(found[0]) <= docs.count()
    assert all(f"_row={3 * int(r.split('doc_id=')[1].split(',')[0])}" in r for r in found[0])


def test_the_pipeline_keeps_a_corpus_without_labels(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    made = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert len(made) > 0.8 * docs.count()


def test_stages_of_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false").withColumn("row", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:4]:
        made = stage(spark, docs, sf)
        assert made.columns == docs.columns and made.count() == 0


@pytest.mark.parametrize("same", [None, 5])
def test_exact_groups_of_one_id(spark, monkeypatch, same):
    """Splitters come from a sample of the rows, whatever their ids are."""
    monkeypatch.setattr(exact_dedup, "SAMPLED", 3)
    given = [(same, f"text {k % 400}") for k in range(2000)]
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(4)
    share = 3 * 4 / 2000
    assert docs.sample(share, exact_dedup.SEED).count() < 60
    got = rows(exact_dedup.exact_groups(docs))
    assert len(got) == 2000 and sum(r["kept"] for r in got) == 400 and {r["group_size"] for r in got} == {5} and {r["keep_id"] for r in got} == {same}


def test_a_point_is_sent_once_for_each_group_of_bits(spark):
    rng = np.random.default_rng(1)
    for n in (2_000, 40_000):
        sample = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        tree = simhash.Tree(sample, 3)
        assert len(tree.groups) > n / 40  # shards grow with the points
        points = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
        assert sum(len(own) for _, own, _ in tree.route(points)) == 4 * len(points)


def test_pairs_meet_where_one_value_of_a_group_is_hot(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 60)
    monkeypatch.setattr(simhash, "FEW", 4)
    rng = np.random.default_rng(4)
    points = (rng.integers(0, 1 << 47, 900, dtype=np.uint64) << np.uint64(16)) | np.uint64(77)  # one value of the lowest group
    points = np.unique(np.concatenate([points, points[:80] ^ np.uint64(1 << 40), points[:60] ^ np.uint64(7 << 20), points[:30] ^ np.uint64(15)]))
    signed = points.view(np.int64).tolist()
    found = {r["node"]: r["component"] for r in simhash.components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))).collect()}
    apart = np.bitwise_count(points[:, None] ^ points[None, :]) <= 3
    low = np.array(signed)
    for _ in range(20):
        low = np.where(apart, low[None, :], np.iinfo(np.int64).max).min(axis=1)
    assert {p: found.get(p, p) for p in signed} == dict(zip(signed, low.tolist(), strict=True)) and apart.sum() > len(points) + 250


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_removal_with_clashing_columns_and_hits(spark, monkeypatch, limit):
    monkeypatch.setattr(decontamination, "SHARD_WORDS", limit)
    word = [f"w{k}" for k in range(60)]
    items = [(1, " ".join(word[:12])), (2, " ".join(word[5:25])), (None, " ".join(word[40:52])), (2, None)]
    texts = ["start " + " ".join(word[:25]) + " end " * 40, " ".join(word[40:52]), "A clean text. ", None, "", "x " * 30_000 + " ".join(word[41:51])]
    docs = spark.createDataFrame([(k % 3 if k else None, t, "a", "b", k) for k, t in enumerate(texts)], "doc_id long, text string, _spans string, spans string, row long").repartition(2)
    made = decontamination.decontaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = {r["row"]: r for r in made.collect()}
    assert made.columns == docs.columns and set(got) == {0, 2, 3, 4, 5} and all((r["_spans"], r["spans"]) == ("a", "b") for r in got.values())
    assert {k: got[k]["text"] for k in (0, 2, 3, 4)} == {0: "start  " + texts[0].split("w24 ")[1], 2: texts[2], 3: None, 4: ""}
    found = {r["n_words"]: r for r in decontamination.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), unnamed=True).collect()}
    for t in texts:
        n, hit, names = plain_hits(t, items, 10)
        assert found[n]["n_words"] == n and {k for s in found[n]["spans"] for k in range(s["start"], s["stop"])} == hit and set(found[n]["items"]) == names


def test_what_was_made_on_the_way_is_deleted(spark, sf):
    others = set(common._made)  # of tests that ran before
    with common.released(spark):
        made = exact_dedup.deduplicated(spark.read.parquet(f"{sf}/documents.parquet"))
        before = made.count()
        kept = set(common._made) - others
        assert kept
    assert before and not kept & set(common._made) and others <= set(common._made)
