"""Expansion of nodes by recorded decisions, with every outcome as a row.

A front of nodes meets its decisions; what may grow yields children, what may not yields a stop reason,
and what went wrong yields a failure while its node stays as it is. A child holds only files of its parent;
one child without any file fails its whole request. Children are the next front."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx
from ..functions.base import first_of, js_or
from .cluster import cut

#: Level from which children count as atomic below it, and the confidence a child starts with.
ATOMIC_LEVEL, CHILD_CONFIDENCE = 3, 0.8
NODE = "id string, parent_id string, name string, description string, level int, files array<string>, snippets array<string>, context string"
DECISION = (
    "id string, should_expand boolean, is_atomic boolean, atomic_reason string, error string, "
    "children array<struct<name string, description string, files array<string>, relevant_files array<string>, impact string, rationale string>>"
)


def _held(child: Column, parent_files: Column) -> Column:
    """Files of a suggested child that its parent has, as suggested."""
    return F.filter(F.coalesce(child["files"], child["relevant_files"]), lambda f: F.array_contains(parent_files, f))


def _problem(child: Column, parent_files: Column) -> Column:
    named = F.coalesce(F.size(F.coalesce(child["files"], child["relevant_files"])), F.lit(0))
    why = first_of([(named <= 0, "no-files"), (F.size(_held(child, parent_files)) == 0, "invalid-files")], F.lit(None).cast("string"))
    return F.struct(why.alias("reason"), child["name"].alias("details"))


def asked(front: DataFrame, decisions: DataFrame) -> DataFrame:
    """The front with outcome (expanded, unchanged, stopped, failed), reason and details.

    Stopped: ``atomic`` or ``ai-decision`` (also without a decision). Failed: the recorded ``error``, or the first child with ``no-files`` or
    only ``invalid-files``. Unchanged: asked to grow, without children."""
    said = decisions.select("id", *[F.col(c).alias(f"_{c}") for c in ("should_expand", "is_atomic", "atomic_reason", "error")], "children")
    rows = front.join(said, "id", "left")
    files = F.coalesce("files", F.array().cast("array<string>"))
    bad = F.get(F.filter(F.transform("children", lambda c: _problem(c, files)), lambda p: p["reason"].isNotNull()), F.lit(0))
    rows = rows.withColumn("files", files).withColumn("_bad", bad)
    none = F.coalesce(F.size("children"), F.lit(0)) <= 0
    row = lambda outcome, reason, details: F.struct(F.lit(outcome).alias("outcome"), reason.alias("reason"), details.alias("details"))
    atomic = F.coalesce("_is_atomic", F.lit(False))
    result = first_of(
        [
            (~F.coalesce("_should_expand", F.lit(False)), row("stopped", F.when(atomic, "atomic").otherwise("ai-decision"), js_or(F.col("_atomic_reason"), "AI decision"))),
            (F.col("_error").isNotNull(), row("failed", F.lit("error"), F.col("_error"))),
            (none, row("unchanged", F.lit(None).cast("string"), F.lit(None).cast("string"))),
            (F.col("_bad").isNotNull(), row("failed", F.col("_bad.reason"), F.col("_bad.details"))),
        ],
        row("expanded", F.lit(None).cast("string"), F.lit(None).cast("string")),
    )
    return rows.withColumn("_r", result).select(*front.columns, "children", "_r.*")


def children_of(rows: DataFrame) -> DataFrame:
    """Nodes of the expanded rows' children, in ``NODE``'s columns and confidence, impact and is_atomic."""
    each = rows.where("outcome = 'expanded'").select("id", "level", "files", "snippets", "context", F.posexplode("children").alias("index", "c"))
    held = _held(F.col("c"), F.col("files"))
    snippets = F.filter(F.coalesce("snippets", F.array().cast("array<string>")), lambda s: F.exists(F.col("held"), lambda f: F.contains(s, f)))
    return each.withColumn("held", held).select(
        jsonx.hierarchical_id("sub", F.col("id"), F.col("index")).alias("id"), F.col("id").alias("parent_id"), F.col("c.name").alias("name"), F.col("c.description").alias("description"),
        (F.col("level") + 1).alias("level"), F.col("held").alias("files"), snippets.alias("snippets"),
        F.concat(F.coalesce("context", F.lit("")), F.lit("\n\nSub-theme: "), F.coalesce("c.description", F.lit(""))).alias("context"),
        F.lit(CHILD_CONFIDENCE).alias("confidence"), js_or(F.col("c.impact"), js_or(F.col("c.rationale"), F.col("c.description"))).alias("impact"), (F.col("level") >= ATOMIC_LEVEL).alias("is_atomic"),
    )


def expanded(roots: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, outcomes) of all levels: nodes with is_expanded, and per node depth, outcome, reason, details,
    file_count, n_children and unassigned (its files that no child took).

    A level is written before the next one reads it, so the plan does not grow with the depth. Identifiers
    grow with each level, so recorded decisions end every branch."""
    front = roots.select(*[F.col(c.split()[0]) for c in NODE.split(", ")], F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("impact"), F.lit(False).alias("is_atomic"))
    nodes, outcomes = [], []
    for depth in count():
        rows = cut(asked(front, decisions))
        grows = F.col("outcome") == "expanded"
        taken = F.flatten(F.transform("children", lambda c: _held(c, F.col("files"))))
        nodes.append(rows.select(*front.columns, grows.alias("is_expanded")))
        outcomes.append(
            rows.select(
                "id", F.lit(depth).alias("depth"), "outcome", "reason", "details", F.size("files").alias("file_count"), F.when(grows, F.size("children")).otherwise(0).alias("n_children"),
                F.when(grows, F.size(F.array_except("files", taken))).otherwise(0).alias("unassigned"),
            )
        )
        front = children_of(rows)
        if rows.where(grows).isEmpty():
            return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, outcomes)


def stop_reasons(outcomes: DataFrame) -> DataFrame:
    """Histogram of outcomes and reasons by depth."""
    return outcomes.groupBy("depth", "outcome", "reason").agg(
        F.count(F.lit(1)).alias("nodes"), F.sum("file_count").alias("files"), F.sum("n_children").alias("children"), F.sum("unassigned").alias("unassigned")
    )


def rebuilt(nodes: DataFrame) -> DataFrame:
    """Bottom up: id, below (nodes under it), height, and leaf_files (files named by the leaves at or under it).

    One join a level, deepest first, on the level's own rows."""
    deepest = nodes.agg(F.max("level")).first()[0]
    lowest = nodes.agg(F.min("level")).first()[0]
    if deepest is None:
        return nodes.select("id", F.lit(0).cast("long").alias("below"), F.lit(0).alias("height"), F.lit(0).cast("long").alias("leaf_files"))
    out, under = [], None
    for level in range(deepest, lowest - 1, -1):
        here = nodes.where(F.col("level") == level).select("id", "parent_id", F.size("files").cast("long").alias("own"))
        if under is None:
            rows = here.select("id", "parent_id", F.lit(0).cast("long").alias("below"), F.lit(0).alias("height"), F.col("own").alias("leaf_files"))
        else:
            sums = under.groupBy(F.col("parent_id").alias("id")).agg(F.sum(F.col("below") + 1).alias("below"), (F.max("height") + 1).alias("height"), F.sum("leaf_files").alias("leaf_files"))
            rows = here.join(sums, "id", "left").select("id", "parent_id", F.coalesce("below", F.lit(0)).alias("below"), F.coalesce("height", F.lit(0)).alias("height"), F.coalesce("leaf_files", "own").alias("leaf_files"))
        under = cut(rows)
        out.append(under.drop("parent_id"))
    return reduce(DataFrame.unionByName, out)
