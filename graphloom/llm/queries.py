"""The registered queries: each operator over its whole table, in the shape its contract fixes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_trie, decontamination, exact_dedup, language_id, lexical_search, neural_lm, packing, pii, preferences, simhash, suffix_dedup, token_counts, warc
from .common import scratch, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    return warc.read(warc.write(table(spark, sf_dir, "pages", "page_id", "url", "html"), folder), folder)


def op2_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation 2k is the chosen one of pair k, 2k + 1 the rejected one."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    found = preferences.paired(preferences.segments(turns, F.expr("shiftright(conv_id, 1)"), F.pmod(F.col("conv_id"), F.lit(2)) == 0))
    listed = lambda mask: F.expr(f"array_join(transform({mask}, s -> concat(s.start, ':', s.stop)), ',')").alias(mask)
    return found.select("pair_id", "block", "prompt", "chosen", listed("chosen_mask"), "rejected", listed("rejected_mask"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_columns(packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("word_bpe_49k.json")))


def packed_columns(packed: DataFrame) -> DataFrame:
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents", "doc_id", "text"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"), unnamed=True)
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        F.col("id").alias("doc_id"), "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    profiles = language_id.learn(docs.where(language_id.learning_part()))
    named = language_id.identify(docs.withColumn("held_out", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2), profiles, ["doc_id", "held_out"])
    return named.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.without_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents", "doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as long)").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS[:4])]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(pii.described("base"), 256).alias("base_sha256"), pii.described("spans").alias("spans"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("piece_bpe_32k.model"))
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7))
    return neural_lm.scores(table(spark, sf_dir, "documents", "doc_id", "text"), left != 2, left == 2).withColumnRenamed("id", "doc_id")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation c starts with the first h turns of c - c % 5; h is crc32(c) % 9."""
    turns = conversation_trie.turns_of(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    own = turns.where("place = 1").select("conv_id", F.expr("conv_id - conv_id % 5").alias("start"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).alias("h"))
    return conversation_trie.trie(*conversation_trie.shared_start(turns, own)).withColumnRenamed("saved_bytes", "saved_tokens")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_warc, op2_preference_formatting, op3_best_fit_packing, op4_exact_dedup, op5_simhash_near_dedup, op6_benchmark_decontamination, op7_language_id, op8_suffix_dedup, op9_pii, op10_token_counts, op11_lm_scoring, op12_conversation_trie, op13_lexical_search)}
