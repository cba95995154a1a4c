"""Themes, nodes and assignments as one another, and the texts that sum a change up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx
from ..functions import predicates as pred
from ..functions.base import js_or

#: Confidence of an assigned child: base, for primary ownership, for cross references, off for a share of the parent's lines outside the limits.
BASE, PRIMARY, REFERENCED, UNEVEN, SHARE = 0.8, 0.1, 0.05, 0.1, (0.1, 0.8)


def theme_nodes(themes: DataFrame) -> DataFrame:
    """Nodes of themes (id, name, level, description, business_impact, detailed_description, files_changed, affected_files, parent_id, confidence)."""
    files = F.coalesce(F.size("affected_files"), F.lit(0))
    return themes.select(
        "id", "name", "level", "description", F.col("business_impact").alias("business_context"), js_or(F.col("detailed_description"), F.col("description")).alias("technical_context"), "affected_files",
        F.when(F.coalesce("files_changed", F.lit(0)) > 2, "high").otherwise("medium").alias("complexity"), F.greatest(files, F.lit(0)).alias("file_count"), "parent_id", F.lit(True).alias("is_primary"),
        F.col("confidence").alias("expansion_confidence"),
    )


def node_themes(nodes: DataFrame) -> DataFrame:
    """Themes of nodes: what ``theme_nodes`` keeps comes back, the description also as the detailed one."""
    return nodes.select(
        "id", "name", "level", "description", F.col("business_context").alias("business_impact"), F.col("description").alias("detailed_description"), F.col("file_count").alias("files_changed"), "affected_files", "parent_id",
        F.col("expansion_confidence").alias("confidence"), F.col("technical_context").alias("context"), F.col("technical_context").alias("technical_summary"), F.array("id").alias("source_themes"), F.lit("expansion").alias("consolidation_method"),
    )


def line_count(code: Column) -> Column:
    """Changed lines of an array of code (file, hunks of changes)."""
    each = F.transform(code, lambda c: F.aggregate(F.transform(c["hunks"], lambda h: F.size(h["changes"])), F.lit(0), lambda a, n: a + n))
    return F.aggregate(each, F.lit(0), lambda a, n: a + n)


def assigned_confidence(lines: Column, parent_lines: Column, primary: Column, references: Column) -> Column:
    """Confidence of a child by its share of the parent's lines; a parent without lines makes any line too many."""
    share = F.when(parent_lines == 0, F.when(lines == 0, F.lit(float("nan"))).otherwise(float("inf"))).otherwise(lines / parent_lines)
    uneven = ~F.isnan(share) & ((share < SHARE[0]) | (share > SHARE[1]))
    plus = F.lit(BASE) + F.when(primary, PRIMARY).otherwise(0.0) + F.when(references > 0, REFERENCED).otherwise(0.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), plus - F.when(uneven, UNEVEN).otherwise(0.0)))


def assignment_nodes(parents: DataFrame) -> DataFrame:
    """Children of parents (id, level, lines, kept: their valid assignments, in order), one row each."""
    each = parents.select("id", "level", "lines", F.posexplode("kept").alias("place", "a"))
    code = F.col("a.assigned_code")
    files = F.array_distinct(F.transform(code, lambda c: c["file"]))
    own = line_count(code)
    return each.select(
        jsonx.hierarchical_id("child", F.col("id"), F.col("place")).alias("id"), F.col("id").alias("parent_id"), (F.col("level") + 1).alias("level"), F.col("a.name").alias("name"), F.col("a.description").alias("description"),
        F.col("a.business_value").alias("business_context"), F.col("a.technical_purpose").alias("technical_context"), files.alias("affected_files"), F.size(files).alias("file_count"), F.lit("medium").alias("complexity"), own.alias("lines"),
        assigned_confidence(own, F.col("lines"), F.col("a.ownership") == "primary", F.lit(0)).alias("expansion_confidence"),
    )


def context_summary(n_files: Column, types: Column, complexity: Column, new: Column, modified: Column, patterns: Column, domains: Column, imports: Column) -> Column:
    """One line of a change: files, types, the first three new and modified functions, patterns, domains, the first two imports, complexity."""

    def listed(label: str, values: Column, most: int | None = None) -> Column:
        shown = values if most is None else F.slice(values, 1, most)
        more = F.lit("") if most is None else F.when(F.size(values) > most, "...").otherwise("")
        return F.when(F.size(values) > 0, F.concat(F.lit(f"{label}: "), F.array_join(shown, ", "), more))

    parts = [
        F.concat(n_files.cast("string"), F.lit(" files changed")), listed("Types", types), listed("New functions", new, 3), listed("Modified functions", modified, 3), listed("Patterns", patterns), listed("Domains", domains),
        listed("New imports", imports, 2), F.concat(F.lit("Complexity: "), complexity),
    ]
    return F.concat_ws(" | ", *parts)


def significant_changes(changes: DataFrame) -> DataFrame:
    """kind (0 new files, 1 deleted files, 2 complex changes), ord, text: what a summary lists, in that order.

    One pass: a change can be listed twice, as a new file and as a complex one."""
    said = F.array(
        F.when(F.col("change_type") == "added", F.struct(F.lit(0).alias("kind"), F.concat(F.lit("New file: "), "file").alias("text"))),
        F.when(F.col("change_type") == "deleted", F.struct(F.lit(1).alias("kind"), F.concat(F.lit("Deleted file: "), "file").alias("text"))),
        F.when((F.col("code_complexity") == "high") & (F.col("semantic_description") != ""), F.struct(F.lit(2).alias("kind"), F.concat(F.lit("Complex change: "), "semantic_description").alias("text"))),
    )
    return changes.select("ord", F.explode(F.array_compact(said)).alias("s")).select("s.kind", "ord", "s.text")


def fallback_theme(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The one theme that stands for files (filename) when nothing else is known, for each of ``keys``: counts, types, flags, size class."""
    name = F.col("filename")
    kind = F.regexp_extract(name, r"[^.]*$", 0)
    n = F.count(F.lit(1))
    row = files.groupBy(*(keys or [])).agg(
        n.alias("total_files"), F.array_sort(F.collect_set(F.when(~kind.isin("", "unknown"), kind))).alias("file_types"), F.coalesce(F.bool_or(name.rlike(r"\.test\.|\.spec\.")), F.lit(False)).alias("has_tests"),
        F.coalesce(F.bool_or(name.rlike(r"\.config\.|package\.json")), F.lit(False)).alias("has_config"), F.when(n > 5, "high").when(n > 2, "medium").otherwise("low").alias("code_complexity"),
    )
    said = F.concat(F.lit("Fallback analysis: "), F.col("total_files").cast("string"), F.lit(" files changed"))
    return row.select(*(keys or []), F.lit("fallback-theme").alias("id"), F.lit("Code Changes").alias("name"), F.lit(0.3).alias("confidence"), *[c for c in row.columns if c not in (keys or [])], said.alias("context_summary"))


def files_by_kind(files: DataFrame, keys: list[str]) -> DataFrame:
    """kind and how many files of it, for each of ``keys``."""
    return files.groupBy(*keys, pred.diff_file_kind(F.col("filename")).alias("kind")).agg(F.count(F.lit(1)).alias("files"))
