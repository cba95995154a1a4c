"""Trees as edge tables: (id, parent_id, ord). Levels come from a frontier loop that ends with the tree."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cluster import cut


def numbered(nodes: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``ordinal``: 1-based place among the children of one parent."""
    return nodes.withColumn("ordinal", F.row_number().over(W.partitionBy("parent_id").orderBy(*order)))


#: After so many levels the frontier is cut off from its lineage and the depth is held against the rows.
CUT_EVERY = 16


def _checked(front: DataFrame, depth: int, edges: DataFrame, what: str) -> DataFrame:
    """``front`` from a checkpoint every ``CUT_EVERY`` levels; a path longer than the table has rows is a cycle."""
    if depth % CUT_EVERY:
        return front
    front = cut(front)
    if depth > edges.count() and not front.isEmpty():
        raise ValueError(f"{what} run in a cycle")
    return front


def levels(nodes: DataFrame) -> DataFrame:
    """id, parent_id, depth (roots 0), path (dotted ordinals), sort_key (pre-order) of a forest with
    ``ordinal``, however deep. The loop joins one frontier a level and ends with the forest. Nodes that no
    root leads to (a closed cycle) are left out; a cycle that a root leads to, which takes an id with
    several parents, raises ValueError."""
    front = nodes.where("parent_id IS NULL").select("id", "parent_id", F.lit(0).alias("depth"), F.col("ordinal").cast("string").alias("path"), F.lpad("ordinal", 8, "0").alias("sort_key"))
    found = [front]
    for depth in count(1):
        up = front.select(F.col("id").alias("parent_id"), F.col("path").alias("_p"), F.col("sort_key").alias("_s"))
        front = nodes.join(up, "parent_id").select("id", "parent_id", F.lit(depth).alias("depth"), F.concat_ws(".", "_p", F.col("ordinal").cast("string")).alias("path"), F.concat_ws(".", "_s", F.lpad("ordinal", 8, "0")).alias("sort_key"))
        front = _checked(front, depth, nodes, "parents")
        if front.isEmpty():
            break
        found.append(front)
    return reduce(DataFrame.unionByName, found)


def rollup(nodes: DataFrame, leaf_depth: int, measures: dict[str, Column]) -> DataFrame:
    """Per node totals of everything at or below it, bottom up; ``nodes`` has id, parent_id, depth and
    the leaves' measures, each summed level by level."""
    names = list(measures)
    level = nodes.where(F.col("depth") == leaf_depth).select("id", "parent_id", "depth", *[m.alias(k) for k, m in measures.items()])
    out = [level]
    for depth in range(leaf_depth - 1, -1, -1):
        below = level.groupBy(F.col("parent_id").alias("id")).agg(*[F.sum(k).alias(k) for k in names])
        here = nodes.where(F.col("depth") == depth).select("id", "parent_id", "depth")
        level = here.join(below, "id", "left").select("id", "parent_id", "depth", *[F.coalesce(k, F.lit(0)).alias(k) for k in names])
        out.append(level)
    return reduce(DataFrame.unionByName, out)


def forest_stats(forest: DataFrame, method: Column, sources: Column, expanded: Column, confidence: Column) -> DataFrame:
    """One row: nodes, max and mean depth, expanded, merged, mean confidence (0 where empty)."""
    return forest.agg(
        F.count(F.lit(1)).alias("n_nodes"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"), F.coalesce(F.avg("depth"), F.lit(0.0)).alias("mean_depth"),
        F.count_if(expanded).alias("n_expanded"), F.count_if((method == "merge") & (sources > 1)).alias("n_merged"), F.coalesce(F.avg(confidence), F.lit(0.0)).alias("mean_confidence"),
    )


def parents_for_groups(items: DataFrame, domain: str, ordinal: str, at_least: int = 2) -> DataFrame:
    """A synthetic parent for each domain of ``at_least`` items: domain, n, first, parent_id, level of its children."""
    groups = items.groupBy(domain).agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("first"))
    return groups.withColumn("parent_id", F.when(F.col("n") >= at_least, F.concat(F.lit("parent-"), F.col(domain)))).withColumn("level", F.when(F.col("n") >= at_least, 1).otherwise(0))


def expand(roots: DataFrame, decisions: DataFrame) -> DataFrame:
    """Top-down expansion: a node whose recorded decision has children is replaced by them as its
    children; a node without one, or with should_expand false, is a leaf. There is no limit of depth; a
    decision that leads back to its own node raises ValueError.

    roots: id, name; decisions: id, should_expand, children array<struct<id, name>>."""
    front = roots.select("id", "name", F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"))
    done = []
    for depth in count():
        asked = front.join(decisions, "id", "left")
        grows = F.coalesce(F.col("should_expand") & (F.size("children") > 0), F.lit(False))
        done.append(asked.select("id", "name", "parent_id", "depth", grows.alias("is_expanded")))
        front = asked.where(grows).select(F.col("id").alias("parent_id"), F.explode("children").alias("c")).select("c.id", "c.name", "parent_id", F.lit(depth + 1).alias("depth"))
        front = _checked(front, depth + 1, decisions, "decisions")
        if front.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)
