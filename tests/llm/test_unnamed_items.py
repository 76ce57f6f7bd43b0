"""Benchmark items without an id: hit and removed, but in no list of ids."""

import hashlib

import duckdb

from graphloom.llm import decontamination, oracles, queries

NAMED = "one two three four five six seven eight nine ten eleven"
UNNAMED = "red green blue white black brown pink grey gold teal cyan"
TEXTS = {1: f"Here is {UNNAMED} to see", 2: f"{NAMED} and {UNNAMED.title()}", 3: NAMED, 4: "nothing of these", 5: None}


def test_hits_follow_the_sql(spark, tmp_path):
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, NAMED), (None, UNNAMED), (None, "Nothing of")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, queries.op6_benchmark_decontamination(spark, str(tmp_path)).collect()))
    base = duckdb.connect()
    for name in ("documents", "benchmark"):
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == sorted(base.execute(oracles.OP6).fetchall())
    assert [(r[2], r[3], r[5]) for r in got] == [(11, 1, True), (22, 2, True), (11, 1, True), (2, 1, True), (0, 0, False)]
    assert got[0][4] == hashlib.sha256(b"").hexdigest() and got[1][4] == hashlib.sha256(b"7").hexdigest()


def test_passages_without_an_id_go(spark):
    more = " and many more words of its own" * 9
    docs = spark.createDataFrame([(1, f"Seen: {UNNAMED}{more}"), (2, UNNAMED), (3, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(None, UNNAMED)], "item_id long, text string")
    assert {r["doc_id"]: r["text"] for r in decontamination.decontaminated(docs, items).collect()} == {1: f"Seen: {more}", 3: "clean"}
