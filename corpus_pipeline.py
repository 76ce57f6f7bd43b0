"""Documents to packed training sequences, stage by stage.

Every stage's result is written to the shared folder and read again, so a lost
executor costs at most the stage that runs. What a stage makes on its way is
deleted once its result is written.

All stages read all rows their predecessor kept and give back its columns,
whatever these are, extra ones too. Null texts count as empty, ids may be null
or repeated, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontamination, exact_dedup, language_id, packing, queries, simhash
from graphloom.llm.common import dropped, released, scratch, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no language that is known: null, empty and letterless ones, and those that fit no profile.

    Where no language can be learned, documents with letters stay. Each row is judged by its text alone.
    """
    return language_id.recognised(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keep the document with the largest id; of repeated ids or null ones, one row."""
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates, keep the document with the smallest id; of repeated ids or null ones, one row."""
    return simhash.deduplicated(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove benchmark passages, and documents that consist of them; ``n_chars`` follows the text."""
    out = decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences; a null or empty text is its end mark alone."""
    return queries.packed_columns(packing.pack(docs, queries.tokenizer("word_bpe_49k.json")))


STAGES = [("language ID", language), ("exact dedup", exact), ("SimHash near-dedup", near), ("benchmark decontamination", clean), ("best-fit packing", packed)]

#: Language profiles and fingerprints have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        path = scratch(spark, "stage")
        with released(spark):
            made = stage(spark, docs, sf_dir)
            written(made, path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            dropped(spark, before)
        before = path
    return docs
