"""Unified diffs as line tables, and what follows from them: imports, exports, edges, components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import code
from ..functions.base import let
from ..functions.predicates import diff_file_kind, is_key_change


def lines(files: DataFrame) -> DataFrame:
    """file, hunk_id, idx, type, line_number, content, is_key of (filename, patch).

    A hunk begins at a line with a header and has its place among them; the line number is its start plus the number of lines
    before that are no deletion; deletions get -1; empty lines and lines before the first header drop out. Patches are cut at their
    headers and each hunk is numbered within its own row, so no line is shuffled or sorted."""
    parts = F.split(F.coalesce("patch", F.lit("")), rf"\n(?=[^\n]*?{code.HUNK})")
    cut = files.select(F.col("filename").alias("file"), F.posexplode(F.filter(parts, lambda p: F.substring_index(p, "\n", 1).rlike(code.HUNK))).alias("hunk_id", "hunk"))
    text, kind = F.split("hunk", "\n"), lambda x: F.when(x.startswith("+"), "add").when(x.startswith("-"), "delete").otherwise("context")
    body = F.transform(F.filter(F.slice(text, F.lit(2), F.size(text)), lambda x: x != ""), lambda x, i: F.struct(i.alias("idx"), kind(x).alias("type"), x.alias("line")))
    row = lambda r, number: F.struct(r["idx"].alias("idx"), r["type"].alias("type"), number.alias("line_number"), r["line"].alias("line"))
    kept = lambda rows: F.transform(F.filter(rows, lambda r: r["type"] != "delete"), lambda r, i: row(r, F.col("start") + i))
    gone = lambda rows: F.transform(F.filter(rows, lambda r: r["type"] == "delete"), lambda r: row(r, F.lit(-1)))
    numbered = cut.select("file", "hunk_id", F.regexp_extract("hunk", code.HUNK, 3).cast("int").alias("start"), body.alias("body"))
    each = numbered.select("file", "hunk_id", F.inline(let(F.col("body"), lambda rows: F.concat(kept(rows), gone(rows)))))
    return each.withColumn("content", F.expr("substring(line, 2)")).select("file", "hunk_id", "idx", "type", "line_number", "content", is_key_change(F.col("content")).alias("is_key"))


def hunks(files: DataFrame) -> DataFrame:
    """file, hunk_id, old_start, old_lines, new_start, new_lines, semantic_context; a missing length is 1."""
    heads = F.filter(F.split(F.coalesce("patch", F.lit("")), "\n"), lambda x: x.rlike(code.HUNK))
    raw = files.select(F.col("filename").alias("file"), F.posexplode(heads).alias("hunk_id", "line"))
    g = lambda i: F.regexp_extract("line", code.HUNK, i)
    size = lambda i: F.when(g(i) == "", 1).otherwise(g(i).cast("int"))
    return raw.select("file", "hunk_id", g(1).cast("int").alias("old_start"), size(2).alias("old_lines"), g(3).cast("int").alias("new_start"), size(4).alias("new_lines"), code.semantic_context(g(5)).alias("semantic_context"))


def _changed(diff: DataFrame) -> DataFrame:
    return diff.where("type <> 'context'").withColumn("change", F.when(F.col("type") == "add", "added").otherwise("removed"))


def import_changes(diff: DataFrame) -> DataFrame:
    return _changed(diff).withColumn("i", code.import_of(F.col("content"))).where("i IS NOT NULL").select("file", F.col("change").alias("type"), "i.module", "i.items", F.col("line_number").alias("line"))


def export_changes(diff: DataFrame) -> DataFrame:
    return _changed(diff).withColumn("e", code.export_of(F.col("content"))).where("e IS NOT NULL").select("file", F.col("change").alias("type"), "e.name", "e.export_type", F.col("line_number").alias("line"))


def dependencies(imports: DataFrame) -> DataFrame:
    """Distinct added modules that are not relative."""
    return imports.where("type = 'added' AND NOT startswith(module, '.')").select("file", "module").distinct()


def symbols(diff: DataFrame) -> DataFrame:
    """Distinct declared names of a file's changed lines, first seen first."""
    rows = F.array_sort(F.collect_list(F.struct("hunk_id", "idx", code.symbols(F.col("content")).alias("s"))))
    return _changed(diff).groupBy("file").agg(F.array_distinct(F.flatten(F.transform(rows, lambda r: r["s"]))).alias("symbols"))


def context_lines(diff: DataFrame, k: int = 3) -> DataFrame:
    """First ``k`` context lines of every hunk."""
    w = W.partitionBy("file", "hunk_id").orderBy("idx")
    return diff.where("type = 'context'").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def relationships(files: DataFrame, imports: DataFrame, mode: str = "faithful") -> DataFrame:
    """source, target, kind, symbols: relative imports, and test files to what they test."""
    used = imports.where("startswith(module, '.')").select(F.col("file").alias("source"), code.resolve_import(F.col("file"), F.col("module"), mode).alias("target"), F.lit("imports").alias("kind"), F.col("items").alias("symbols"))
    tests = files.where(diff_file_kind(F.col("filename")) == "test").select(F.col("filename").alias("source"), code.tested_file(F.col("filename")).alias("target"), F.lit("tests").alias("kind"), F.array().cast("array<string>").alias("symbols")).where("target IS NOT NULL")
    return used.unionByName(tests)


def shared_components(exports: DataFrame, edges: DataFrame) -> DataFrame:
    """Exported names that another file imports: component, name, defined_in, type, used_in.

    An equi-join on (file, symbol); a name exported twice counts as its last export."""
    defined = exports.groupBy(F.col("file").alias("defined_in"), "name").agg(F.max_by("type", "line").alias("change"))
    used = edges.where("kind = 'imports'").select(F.col("target").alias("defined_in"), F.explode("symbols").alias("name"), "source")
    both = defined.join(used, ["defined_in", "name"])
    kind = code.component_type(F.col("name"), F.col("defined_in"), diff_file_kind(F.col("defined_in")))
    return both.groupBy("defined_in", "name").agg(F.array_sort(F.collect_list("source")).alias("used_in"), F.first("change").alias("change")).select(F.concat_ws(":", "defined_in", "name").alias("component"), "name", "defined_in", kind.alias("type"), "change", "used_in")


def business_patterns(files: DataFrame) -> DataFrame:
    """UI, API and test files, one row for each kind that has any."""
    p = F.col("filename")
    has = lambda *parts: reduce(lambda a, b: a | b, [F.contains(p, F.lit(x)) for x in parts])
    kinds = [("user-flow", has("components", "pages", "views"), 0.9), ("api-endpoint", has("api", "routes", "controllers"), 0.9), ("testing", diff_file_kind(p) == "test", 1.0)]
    tags = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("type"), F.lit(x).alias("confidence"))) for k, c, x in kinds]))
    return files.select("filename", F.explode(tags).alias("t")).groupBy("t.type", "t.confidence").agg(F.array_sort(F.collect_list("filename")).alias("files"))


def total_complexity(files: DataFrame, diff: DataFrame, imports: DataFrame, exports: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """One row: sum over files of capped changes, type weight and counts, at most 100."""
    count = lambda df, name: df.groupBy(F.col("file").alias("filename")).agg(F.count(F.lit(1)).alias(name))
    parts = [count(diff.where("type <> 'context'"), "c"), count(imports, "i"), count(exports, "e")] + ([count(semantic, "s")] if semantic is not None else [])
    all_ = reduce(lambda a, b: a.join(b, "filename", "left"), parts, files.select("filename"))
    n = lambda k: F.coalesce(k, F.lit(0)) if k in all_.columns else F.lit(0)
    each = code.file_complexity(n("c"), diff_file_kind(F.col("filename")), n("s"), n("i"), n("e"))
    return all_.agg(F.least(F.coalesce(F.sum(each), F.lit(0.0)), F.lit(100.0)).alias("complexity"))


def line_keys(diff: DataFrame) -> DataFrame:
    """Positional keys file:hunk:idx:content of all lines."""
    return diff.select(F.concat_ws(":", "file", F.col("hunk_id").cast("string"), F.col("idx").cast("string"), "content").alias("key"), "file")


def numbered(diff: DataFrame) -> DataFrame:
    """Lines of a file with a running number over its hunks."""
    return diff.withColumn("number", F.row_number().over(W.partitionBy("file").orderBy("hunk_id", "idx")))


def to_snippets(diff: DataFrame, heads: DataFrame) -> DataFrame:
    """Line table back to unified text, one snippet a hunk."""
    sign = F.when(F.col("type") == "add", "+").when(F.col("type") == "delete", "-").otherwise(" ")
    rows = F.array_sort(F.collect_list(F.struct("idx", F.concat(sign, F.col("content")).alias("l"))))
    body = diff.groupBy("file", "hunk_id").agg(F.array_join(F.transform(rows, lambda r: r["l"]), "\n").alias("body"))
    head = F.format_string("@@ -%d,%d +%d,%d @@", "old_start", "old_lines", "new_start", "new_lines")
    return heads.join(body, ["file", "hunk_id"], "left").select("file", "hunk_id", F.concat_ws("\n", F.concat(F.lit("--- a/"), F.col("file")), F.concat(F.lit("+++ b/"), F.col("file")), head, "body").alias("snippet"))


def coverage(parent: DataFrame, children: DataFrame) -> dict[str, DataFrame]:
    """Lines of the parent that no child has, lines that two have, and child lines that the parent lacks."""
    p, c = line_keys(parent), line_keys(children)
    return {
        "unassigned": p.join(c.select("key"), "key", "left_anti"), "duplicated": c.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "unknown": c.join(p.select("key"), "key", "left_anti"),
    }
