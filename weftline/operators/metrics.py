"""Reports over fact rows: rates, histograms, percentiles, stage shares, cache and call counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.base import first_of
from .ordered import value_at_rank


def score_bucket(x: Column) -> Column:
    """Five left-closed buckets; the last has no end."""
    return first_of([(x < 0.2, "0.0-0.2"), (x < 0.4, "0.2-0.4"), (x < 0.6, "0.4-0.6"), (x < 0.8, "0.6-0.8")], "0.8-1.0")


def group_report(facts: DataFrame, keys: list[str], expanded: Column, corrected: Column, confidence: Column, ms: Column) -> DataFrame:
    """n, rates and means for each group (whole frame: no keys)."""
    rate = lambda c: F.avg(c.cast("double"))
    agg = [F.count(F.lit(1)).alias("n"), rate(expanded).alias("expansion_rate"), rate(corrected).alias("correction_rate"), F.avg(confidence).alias("mean_confidence"), F.avg(ms).alias("mean_ms")]
    return facts.groupBy(*keys).agg(*agg) if keys else facts.agg(*agg)


def score_report(facts: DataFrame, scores: list[str]) -> DataFrame:
    """Per score: n, mean, upper median, min, max (unpivoted, one pass over the columns)."""
    long = facts.unpivot([], scores, "score", "value").where("value IS NOT NULL")
    stats = long.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    return stats.join(value_at_rank(long, ["score"], "value", {"median": 0.5}), "score")


def score_histogram(facts: DataFrame, scores: list[str]) -> DataFrame:
    long = facts.unpivot([], scores, "score", "value").where("value IS NOT NULL")
    return long.groupBy("score", score_bucket(F.col("value")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def population_variance(*columns: Column) -> Column:
    """Of one row's values, added left to right."""
    n = len(columns)
    mean = sum(columns[1:], columns[0]) / n
    return sum([(c - mean) * (c - mean) for c in columns[1:]], (columns[0] - mean) * (columns[0] - mean)) / n


def needs_check(*scores: Column, above: float = 0.2) -> Column:
    return population_variance(*scores) > above


def stage_shares(spans: DataFrame, parent: str, ms: str, bottleneck: float = 0.7) -> DataFrame:
    """Share of the parent's total; NaN where that is 0, which is no bottleneck."""
    total = F.sum(ms).over(W.partitionBy(parent))
    share = F.when(total == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.col(ms), total))
    return spans.withColumn("share", share).withColumn("bottleneck", (F.col("share") > bottleneck) & ~F.isnan("share"))


def call_report(calls: DataFrame, context: str, ms: str, name: str, slow_ms: float = 5000.0) -> DataFrame:
    """Per context: calls, mean, max and which call was slowest, slow calls, share of all time."""
    stats = calls.groupBy(context).agg(F.count(F.lit(1)).alias("n"), F.avg(ms).alias("mean_ms"), F.max(ms).alias("max_ms"), F.max_by(name, F.struct(ms, name)).alias("slowest"), F.count_if(F.col(ms) > slow_ms).alias("n_slow"), F.sum(ms).alias("total"))
    whole = float(calls.agg(F.sum(ms)).first()[0] or 0.0)
    return stats.withColumn("share", F.col("total") / F.lit(whole or 1.0)).drop("total")


def effectiveness(before: Column, after: Column) -> Column:
    """Per cent by which a step reduced its input; 0 for no input."""
    return F.when(before > 0, (before - after) / before * 100).otherwise(F.lit(0.0))


def cache_report(log: DataFrame, kind: str, hit: Column, age: Column, at_least: int = 10) -> DataFrame:
    """Per kind with over ``at_least`` requests: hits, misses, hit rate and hit-weighted mean age."""
    agg = log.groupBy(kind).agg(F.count(F.lit(1)).alias("requests"), F.count_if(hit).alias("hits"), F.avg(F.when(hit, age)).alias("mean_age"))
    return agg.where(F.col("requests") > at_least).withColumn("hit_rate", F.col("hits") / F.col("requests"))


def problem_areas(report: Column) -> Column:
    """Messages of a summary struct (expansion_rate, correction_rate, mean_confidence, mean_ms)."""
    r = report
    return F.array_compact(
        F.array(
            F.when(r["expansion_rate"] > 0.8, F.lit("Expansion rate is very high")), F.when(r["expansion_rate"] < 0.2, F.lit("Expansion rate is very low")),
            F.when(r["correction_rate"] > 0.3, F.lit("Consistency corrections are frequent")), F.when(r["mean_confidence"] < 0.6, F.lit("Decisions have low confidence")),
            F.when(r["mean_ms"] > 5000, F.lit("Decisions are slow")),
        )
    )


def complexity_class(n_high: Column, n_medium: Column, n: Column) -> Column:
    return first_of([((n_high > 0) | (n > 10), "high"), ((n_medium > 1) | (n > 3), "medium")], "low")


def file_metrics(changes: DataFrame) -> DataFrame:
    """One row over code changes: files, types, any test, any config, complexity."""
    agg = changes.agg(
        F.count(F.lit(1)).alias("total_files"), F.array_sort(F.collect_set(F.when(~F.col("file_type").isin("", "unknown"), F.col("file_type")))).alias("file_types"),
        F.coalesce(F.bool_or("is_test"), F.lit(False)).alias("has_tests"), F.coalesce(F.bool_or("is_config"), F.lit(False)).alias("has_config"),
        F.count_if(F.col("code_complexity") == "high").alias("_h"), F.count_if(F.col("code_complexity") == "medium").alias("_m"),
    )
    return agg.withColumn("code_complexity", complexity_class(F.col("_h"), F.col("_m"), F.col("total_files"))).drop("_h", "_m")


def change_patterns(changes: DataFrame) -> DataFrame:
    """One row of distinct lists by change type, first seen first."""

    def listed(kind: str, col: str):
        rows = F.array_sort(F.collect_list(F.when(F.col("change_type") == kind, F.struct("ord", col))))
        return F.array_distinct(F.flatten(F.transform(rows, lambda r: r[col])))

    rows = F.array_sort(F.collect_list(F.struct("ord", F.coalesce("architectural_patterns", F.array().cast("array<string>")).alias("p"))))
    domains = F.array_sort(F.collect_list(F.when(F.col("business_domain") != "unknown", F.struct("ord", "business_domain"))))
    return changes.agg(
        listed("added", "functions_changed").alias("new_functions"), listed("modified", "functions_changed").alias("modified_functions"), listed("added", "imports_changed").alias("new_imports"),
        listed("deleted", "imports_changed").alias("removed_imports"), listed("added", "classes_changed").alias("new_classes"), listed("modified", "classes_changed").alias("modified_classes"),
        F.array_distinct(F.flatten(F.transform(rows, lambda r: r["p"]))).alias("architectural_patterns"), F.array_distinct(F.transform(domains, lambda r: r["business_domain"])).alias("business_domains"),
    )
