"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import conversation_repair, decontaminate, edit_counts, filter_audit, license_scan, mixing, projected_neighbours, rules, simhash, token_files, topk, toxicity, warc
from sievewright.llm.common import shared_dir, table, written

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings")).select("query_id", "rank", "vec_id", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, field).select("doc_id", "held_out", "score", "predicted", F.to_json("spans").alias("spans"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    archives = warc.archive(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; texts are read once, for their sizes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.size_of(F.col("text")).alias("size"))
    return mixing.planned(written(docs, "sized")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "tokens")
    shards = token_files.write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer_file("word_bpe_49k.json"))
    return token_files.read_token_files(spark, folder, shards)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every whole document before and after three edits; encoded: characters that the edits had encoded anew."""
    import public_tokenizers

    path, pattern = tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    state = edit_counts.build(table(spark, sf_dir, "documents"), path, pattern)
    edited = edit_counts.apply_edits(state.withColumn("edits", edit_counts.sample_edits(F.col("doc_id"), F.col("text"))), path, pattern)
    return edited.select("doc_id", "n_tokens_before", "n_tokens", "encoded", F.length("text").cast("long").alias("n_chars"), F.size("sizes").cast("long").alias("n_leaves"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules.scored(docs, rules.train(docs, table(spark, sf_dir, "labels")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters takes in each of their 120 orders, for each source."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found for each one whose id is divisible by 50."""
    return projected_neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of damaged conversations and their cheapest repair."""
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Query]:
    own = [op1_license_scan, op2_exact_topk, op3_toxicity, op4_warc, op5_source_mix, op6_token_files, op7_simhash, op8_decontaminate, op9_edit_counts, op10_quality, op11_filter_audit, op12_projected_neighbours, op13_conversation_repair]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_scan.scan_sql(),
        "op2_exact_topk": topk.top_k_sql(),
        "op4_warc": warc.archive_sql(),
        "op5_source_mix": mixing.mix_sql(),
        "op8_decontaminate": decontaminate.contamination_sql(),
        "op11_filter_audit": filter_audit.audit_sql(),
        "op13_conversation_repair": conversation_repair.repair_sql(),
    }
