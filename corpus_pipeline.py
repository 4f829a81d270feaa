"""The corpus pipeline: language ID, SimHash near-duplicates, secret redaction, source mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canasta.llm import language, mixing, packing, secrets, simhash
from canasta.operators.skew import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; those without a letter go. `lang` becomes the predicted language."""
    found = language.identify(docs.select(COLUMNS))
    return found.where(F.col("lang_pred") != "und").withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    return simhash.keep_one(docs.select(COLUMNS))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become marks; n_chars follows."""
    clean = secrets.redact_secrets(docs.select(COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents that it does not take go, those that it takes twice occur twice."""
    return mixing.mix_documents(docs.select(COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, one row each."""
    return packing.pack_documents(docs)


STAGES = [("language ID", identify_language), ("near duplicates", drop_near_duplicates), ("secrets", redact), ("mixing", mix_sources), ("packing", pack)]

# Fingerprints, model training and packing have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if i + 1 == len(STAGES) else cut(docs, "stage")
    return docs
