"""Sinks: saved analyses, review results, comment upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import upsert


def save_json(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def save_analysis(themes: DataFrame, mode: str, at: str, path: str) -> None:
    """One document of all themes with its metadata (small: one analysis's themes)."""
    body = themes.agg(F.array_sort(F.collect_list(F.struct(*themes.columns))).alias("themes"), F.count(F.lit(1)).alias("n"))
    doc = body.select(F.struct(F.lit(at).alias("timestamp"), F.lit(mode).alias("mode"), F.col("n").cast("int").alias("totalThemes")).alias("metadata"), F.struct("themes").alias("rawAnalysis"))
    save_json(doc, path)


def save_review(nodes: DataFrame, summary: DataFrame, path: str) -> None:
    save_json(nodes.withColumn("version", F.lit("2.0")), f"{path}/nodes")
    save_json(summary, f"{path}/summary")


def clean(df: DataFrame, path: str) -> None:
    """Replace what is there by an empty frame of the same schema."""
    save_json(df.limit(0), path, "overwrite")


def upsert_comments(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Comments by (target, marker): an existing one is updated, else inserted."""
    return upsert(existing, new, ["target", "marker"])


def post_each(df: DataFrame, send) -> None:
    """One call of ``send(row)`` a row, on the executors."""
    df.foreachPartition(lambda rows: [send(r) for r in rows] and None)
