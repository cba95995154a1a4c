"""Projection queries: customers as themes and nodes, their assignments as children, summaries of what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import assignments
from ..operators import projections
from .expansions import _FLAT_SQL, _assigned
from .rules import _CHANGE, _FILES_SQL, _KIND, _files
from .tables import read


def theme_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as themes over their orders, to nodes and back."""
    orders = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("o_orderpriority")).alias("files"))
    c = read(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    themes = c.select(
        F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(0).alias("level"), F.concat(F.lit("about "), "c_mktsegment").alias("description"), F.col("c_mktsegment").alias("business_impact"),
        F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, F.col("c_name")).alias("detailed_description"), F.col("n").alias("files_changed"), F.col("files").alias("affected_files"),
        F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.round(F.col("c_acctbal") / 10000, 6).alias("confidence"),
    )
    nodes = projections.theme_nodes(themes)
    back = projections.node_themes(nodes)
    shown = nodes.select("id", "technical_context", "complexity", "file_count", "expansion_confidence")
    return shown.join(back.select("id", F.col("context").alias("back_context"), F.col("files_changed").alias("back_files"), F.array_join("source_themes", ",").alias("sources"), "consolidation_method", "parent_id"), "id")


NODES_SQL = """
WITH o AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS f FROM orders GROUP BY 1),
t AS (SELECT *, 'c' || c_custkey AS id, CASE WHEN c_custkey % 3 = 1 THEN c_name ELSE 'about ' || c_mktsegment END AS text FROM customer LEFT JOIN o ON o_custkey = c_custkey)
SELECT id, text AS technical_context, CASE WHEN coalesce(n, 0) > 2 THEN 'high' ELSE 'medium' END AS complexity, coalesce(f, 0)::INT AS file_count, round(c_acctbal / 10000, 6) AS expansion_confidence,
  text AS back_context, coalesce(f, 0)::INT AS back_files, id AS sources, 'expansion' AS consolidation_method, 'n' || c_nationkey AS parent_id FROM t
"""


def assignment_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of customers from what is kept of their assignments, with their confidence by share of lines."""
    rows = _assigned(spark, sf_dir)
    every = F.flatten(F.transform("assignments", lambda a: F.coalesce(a["assigned_code"], F.array().cast(f"array<{assignments.CODE}>"))))
    lines = F.aggregate(
        F.flatten(F.transform(F.filter(every, lambda c: c["hunks"].isNotNull()), lambda c: c["hunks"])), F.lit(0), lambda s, h: s + F.when(h["changes"].isNull(), 0).otherwise(F.size(h["changes"]))
    )
    parents = rows.select(F.concat(F.lit("c"), F.col("o_custkey")).alias("id"), F.lit(2).alias("level"), lines.alias("lines"), assignments.kept(F.col("assignments")).alias("kept"))
    found = projections.assignment_nodes(parents)
    return found.select("id", "parent_id", "level", "name", F.array_join("affected_files", ",").alias("affected_files"), "file_count", "lines", F.round("expansion_confidence", 6).alias("confidence"))


CHILDREN_SQL = f"""
WITH {_FLAT_SQL},
parent AS (SELECT c, count(*) FILTER (coalesce(ra, '') <> 'missing assigned_code' AND o % 19 <> 0 AND coalesce(rc, '') <> 'missing hunks' AND rh IS NULL) AS lines FROM f GROUP BY c),
child AS (SELECT c, o, any_value(prio) AS name, string_agg(DISTINCT 'file.' || lower(rf), ',' ORDER BY 'file.' || lower(rf)) FILTER (code_ok) AS files, count(DISTINCT rf) FILTER (code_ok) AS n, count(*) FILTER (code_ok AND hunk_ok AND rv IS NULL) AS lines FROM f WHERE ok GROUP BY c, o),
r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY o) - 1 AS place FROM child)
SELECT 'c' || r.c || '_child_' || place AS id, 'c' || r.c AS parent_id, 3 AS level, name, files AS affected_files, n::INT AS file_count, r.lines::INT AS lines,
  round(0.8::DOUBLE + 0.1 - CASE WHEN r.lines / parent.lines < 0.1::DOUBLE OR r.lines / parent.lines > 0.8::DOUBLE THEN 0.1 ELSE 0 END, 6) AS confidence FROM r JOIN parent ON parent.c = r.c
"""


def change_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand as one change: its summary line, fallback theme and the number of significant changes by kind."""
    f = _files(spark, sf_dir)
    sets = lambda when, what: F.array_sort(F.collect_set(F.when(when, what)))
    status, p = F.col("letter"), F.col("path")
    agg = f.groupBy("brand").agg(
        F.count(F.lit(1)).alias("n"), sets(F.lit(True), F.regexp_extract(p, r"[^./]*$", 0)).alias("types"), sets(status == "A", F.col("p_name")).alias("new"), sets(status == "M", F.col("p_name")).alias("modified"),
        sets(status == "R", F.col("name")).alias("patterns"), sets(status == "C", F.col("level")).alias("domains"), sets(status == "D", F.col("said")).alias("imports"), F.max("level").alias("complexity"),
    )
    line = projections.context_summary(*[F.col(c) for c in ("n", "types", "complexity", "new", "modified", "patterns", "domains", "imports")])
    kind = F.when(status == "A", "added").when(status == "D", "deleted").otherwise("modified")
    changes = f.select(F.struct("brand", "key").alias("ord"), kind.alias("change_type"), p.alias("file"), F.when(F.col("n") > 25, "high").otherwise("low").alias("code_complexity"), F.when(F.col("n") % 7 > 0, F.col("said")).otherwise("").alias("semantic_description"))
    told = projections.significant_changes(changes).groupBy(F.col("ord.brand").alias("brand")).agg(*[F.count_if(F.col("kind") == i).alias(f"told_{i}") for i in range(3)], F.min(F.struct("kind", "ord", "text"))["text"].alias("first_told"))
    fallback = projections.fallback_theme(f.withColumn("filename", p), ["brand"]).select("brand", "has_tests", "has_config", "code_complexity", F.array_join("file_types", ",").alias("file_types"), "context_summary")
    kinds = projections.files_by_kind(f.withColumn("filename", p), ["brand"]).groupBy("brand").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "kind", F.col("files").cast("string")))), ";").alias("kinds"))
    return agg.select("brand", line.alias("summary")).join(told, "brand", "left").join(fallback, "brand").join(kinds, "brand")


def _agg(when: str, what: str) -> str:
    return f"coalesce(list_sort(list_distinct(list({what}) FILTER ({when} AND {what} IS NOT NULL))), [])"


def _listed(label: str, column: str, most: int | None = None) -> str:
    shown = column if most is None else f"{column}[1:{most}]"
    more = "''" if most is None else f"CASE WHEN len({column}) > {most} THEN '...' ELSE '' END"
    return f"CASE WHEN len({column}) > 0 THEN '{label}: ' || array_to_string({shown}, ', ') || {more} END"


SUMMARY_SQL = f"""
WITH {_FILES_SQL}, x AS (SELECT *, {_KIND} AS kind, {_CHANGE} AS change_type, regexp_extract(path, '[^.]*$', 0) AS ending FROM f),
a AS (SELECT brand, count(*) AS n, {_agg("true", "regexp_extract(path, '[^./]*$', 0)")} AS types, {_agg("letter = 'A'", "p_name")} AS new, {_agg("letter = 'M'", "p_name")} AS modified, {_agg("letter = 'R'", "name")} AS patterns,
  {_agg("letter = 'C'", "level")} AS domains, {_agg("letter = 'D'", "said")} AS imports, max(level) AS complexity, count(*) FILTER (letter = 'A') AS told_0, count(*) FILTER (letter = 'D') AS told_1, count(*) FILTER (n > 25 AND n % 7 > 0) AS told_2,
  coalesce('New file: ' || arg_min(path, key) FILTER (letter = 'A'), 'Deleted file: ' || arg_min(path, key) FILTER (letter = 'D'), 'Complex change: ' || arg_min(said, key) FILTER (n > 25 AND n % 7 > 0)) AS first_told,
  bool_or(regexp_matches(path, '\\.test\\.|\\.spec\\.')) AS has_tests, bool_or(regexp_matches(path, '\\.config\\.|package\\.json')) AS has_config, {_agg("ending NOT IN ('', 'unknown')", "ending")} AS endings FROM x GROUP BY brand),
k AS (SELECT brand, string_agg(t, ';' ORDER BY t) AS kinds FROM (SELECT brand, kind || '=' || count(*) AS t FROM x GROUP BY brand, kind) GROUP BY brand)
SELECT brand, concat_ws(' | ', n || ' files changed', {_listed("Types", "types")}, {_listed("New functions", "new", 3)}, {_listed("Modified functions", "modified", 3)}, {_listed("Patterns", "patterns")}, {_listed("Domains", "domains")},
  {_listed("New imports", "imports", 2)}, 'Complexity: ' || complexity) AS summary, told_0, told_1, told_2, first_told, has_tests, has_config, CASE WHEN n > 5 THEN 'high' WHEN n > 2 THEN 'medium' ELSE 'low' END AS code_complexity,
  array_to_string(endings, ',') AS file_types, 'Fallback analysis: ' || n || ' files changed' AS context_summary, kinds FROM a JOIN k USING (brand)
"""

QUERIES = {f.__name__: f for f in (theme_nodes, assignment_nodes, change_summaries)}
ORACLES = dict(zip(QUERIES, (NODES_SQL, CHILDREN_SQL, SUMMARY_SQL), strict=True))
