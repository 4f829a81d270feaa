"""The named queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from canasta.llm import chat, decontamination, language, lexical, mixing, packing, quality, secrets, simhash, substring, topk, trie, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(name: str, digest: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: digest(spark.read.parquet(f"{folder}/{name}.parquet"))


QUERIES["op1_embedding_near_dedup"] = table("embeddings", vectors.digest)
ORACLE["op1_embedding_near_dedup"] = vectors.SQL
QUERIES["op2_packing"] = table("documents", packing.digest)
QUERIES["op3_secret_scan"] = table("documents", secrets.digest)
ORACLE["op3_secret_scan"] = secrets.SQL
QUERIES["op4_source_mixing"] = table("documents", mixing.digest)
QUERIES["op5_simhash_near_dedup"] = table("documents", simhash.digest)
QUERIES["op6_substring_dedup"] = table("documents", substring.digest)
ORACLE["op6_substring_dedup"] = substring.SQL
QUERIES["op7_exact_topk"] = table("embeddings", topk.digest)
ORACLE["op7_exact_topk"] = topk.SQL
QUERIES["op8_quality_cotraining"] = lambda spark, folder: quality.classify(
    spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
QUERIES["op9_chat_format"] = table("conversations", chat.digest)
ORACLE["op9_chat_format"] = chat.SQL
QUERIES["op10_language_id"] = table("documents", language.digest)
QUERIES["op11_decontamination"] = lambda spark, folder: decontamination.digest(
    spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))
ORACLE["op11_decontamination"] = decontamination.SQL
QUERIES["op12_lexical_search"] = lambda spark, folder: lexical.digest(
    spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))
ORACLE["op12_lexical_search"] = lexical.SQL
QUERIES["op13_prefix_trie"] = table("conversations", trie.digest)
ORACLE["op13_prefix_trie"] = trie.SQL
