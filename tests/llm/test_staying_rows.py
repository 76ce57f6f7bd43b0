"""Rows that stay are told by bits; no text is dealt out to drop the others."""

import pytest
from graphloom.llm import common, exact_dedup, simhash
from pyspark.sql import functions as F


@pytest.mark.parametrize("bits", [3, common.BLOCK_BITS])
def test_rows_are_those_of_a_semi_join(spark, bits):
    docs = spark.range(0, 900, 1, 5).select(F.col("id").alias("n"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit(None).cast("void").alias("other"))
    own = docs.withColumn("_row", F.monotonically_increasing_id())
    for picked in ("n % 7 = 0", "n < 200 or n = 777", "n between 300 and 310", "true", "false"):
        stays = own.where(picked).select("_row").repartition(3)
        made = common.only(own, "_row", stays, bits)
        assert made.columns == own.columns
        assert sorted(r["n"] for r in made.collect()) == sorted(r["n"] for r in docs.where(picked).collect())


@pytest.mark.parametrize("part", [exact_dedup, simhash])
def test_no_text_is_shuffled_to_drop_rows(spark, sf, capsys, part):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    made = part.deduplicated(docs)
    made.explain()
    plan = capsys.readouterr().out
    assert "Scan parquet" in plan and "Exchange" not in plan and "Join" not in plan
    assert 0 < made.count() < docs.count()
