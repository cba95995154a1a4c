"""Review roll-ups: severities, recommendation, confidence, action items, location, risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.base import clamp, first_of, lookup

# fixed values
RISK_ORDER = {"low": 1, "medium": 2, "high": 3, "critical": 4}
ACTION_ORDER = {"critical": 1, "major": 2}
TTL_BANDS = ((0.9, 4.0), (0.7, 2.0), (0.5, 1.0))


def severity_counts(severity: Column) -> list[Column]:
    """Aggregates critical, major, minor, suggestion."""
    return [F.count_if(severity == s).alias(s) for s in ("critical", "major", "minor", "suggestion")]


def recommendation(n: Column, critical: Column, high_risk: Column, major_nodes: Column, low_confidence: Column) -> Column:
    return first_of([((critical > 0) | (high_risk > 0), "request-changes"), ((major_nodes > 2) | (low_confidence > n / 2), "needs-discussion")], "approve")


def recommend(nodes: DataFrame, keys: list[str], low: float = 0.6) -> DataFrame:
    """nodes: critical, major (counts), risk_level, confidence → one row a review."""
    agg = nodes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("critical") > 0).alias("critical_nodes"), F.count_if(F.col("risk_level").isin("high", "critical")).alias("high_risk_nodes"),
        F.count_if(F.col("major") > 0).alias("major_nodes"), F.count_if(F.col("confidence") < low).alias("low_confidence_nodes"),
    )
    return agg.withColumn("recommendation", recommendation(F.col("n_nodes"), F.col("critical_nodes"), F.col("high_risk_nodes"), F.col("major_nodes"), F.col("low_confidence_nodes")))


def review_confidence(has_context: Column, has_issues: Column, has_recommendations: Column, has_tests: Column, critical: Column, high: Column) -> Column:
    """0.5 +0.2 +0.1 +0.1 +0.1, less 0.2 for a critical or 0.1 for a high risk, in 0.1..1; added in this order."""
    bonus = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    total = F.lit(0.5) + bonus(has_context, 0.2) + bonus(has_issues, 0.1) + bonus(has_recommendations, 0.1) + bonus(has_tests, 0.1)
    return clamp(total - F.when(critical, 0.2).when(high, 0.1).otherwise(0.0), 0.1, 1.0)


def ttl_factor(confidence: Column) -> Column:
    """How much longer an answer of that confidence is kept."""
    return first_of([(confidence >= c, f) for c, f in TTL_BANDS], 0.5)


def action_items(issues: DataFrame, key: str, order: str) -> DataFrame:
    """Critical and major issues, ranked in each review by priority, then by original order."""
    found = issues.where(F.col("severity").isin(*ACTION_ORDER)).withColumn("priority", lookup(F.col("severity"), ACTION_ORDER, 9))
    return found.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("priority", order)))


def summary_text(n: Column, critical: Column, major: Column, minor: Column, mean: Column) -> Column:
    return F.format_string("Reviewed %d nodes: %d critical, %d major, %d minor. Mean confidence %.1f%%.", n, critical, major, minor, mean * 100)


def locate(path: Column, snippet: Column, files: Column) -> Column:
    """First file (struct path, snippets) that the issue's text names or whose snippet holds it, else the first."""
    hit = F.filter(files, lambda f: F.contains(path, f["path"]) | F.contains(f["path"], path) | F.exists(f["snippets"], lambda s: F.contains(s, snippet)))
    return F.coalesce(F.get(hit, F.lit(0)), F.get(files, F.lit(0)))["path"]


def risk_rollup(leaves: DataFrame, levels: list[str], risk: str) -> list[DataFrame]:
    """Greatest risk of everything below, level by level (``levels``: key columns, deepest first)."""
    out, current = [], leaves
    for i, key in enumerate(levels):
        keys = levels[i:]
        current = current.groupBy(*keys).agg(F.max(risk).alias(risk), F.sum("n").alias("n"))
        out.append(current.select(F.lit(key).alias("level"), F.col(key).cast("string").alias("key"), risk, "n"))
    return out
