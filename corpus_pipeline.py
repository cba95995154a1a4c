"""Corpus pipeline: language identification, exact and near deduplication, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; ``run`` writes every stage's rows
as Parquet and reads them back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, exact_dedup, language_id, near_dedup, sentencepieces
from weftline.llm.common import materialise, release, table
from weftline.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a language model of their own corpus accepts (two thirds of it train the model)."""
    model = language_id.fit(docs.where(language_id.fold_of(F.col("doc_id"), 3) != 1))
    return language_id.accepted(docs, model, z=12.0)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document of the largest doc_id."""
    release(spark)
    return exact_dedup.deduplicate(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the least doc_id."""
    release(spark)
    return near_dedup.deduplicate(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    release(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and the text decoded from them."""
    release(spark)
    coded = sentencepieces.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer_path())
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("sentencepiece", encode_text),
]

#: SQL states none of the language, near-duplicate and token stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
