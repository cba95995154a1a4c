"""Diff queries: orders as files of a change, their lines as the lines of a patch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as pred
from ..operators import crossref, diff, relational
from .rules import _any, _list, _pick
from .tables import read

LINES = (
    "import { useA, useB } from './part'", "import React from 'react'", "import * as all from \"lib/all\"", "export const total = 1", "export default function main() {", "class Order extends Base {", "return total", "function sum(a) {", "// note", "",
    "const a = 1, b = 2", "await save()", "export type Kind = string", "import { x } from 'react'", "delete rows[0]", "let count = 0",
)
HEADS = ("@@ -1,4 +1,6 @@ function main() {", "@@ -10 +12,2 @@", "@@ -20,0 +30 @@ class Order", "@@ -7,3 +9,3 @@ export const total")
ENDINGS = (".ts", ".test.ts", ".md", ".js")


def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filename and patch of every order: a hunk head before every third line, the sign by return flag."""
    li = read(spark, sf_dir, "lineitem")
    sign = F.when(F.col("l_returnflag") == "A", "+").when(F.col("l_returnflag") == "R", "-").otherwise(" ")
    body = F.concat(sign, _pick(LINES, F.col("l_partkey") % len(LINES)))
    text = F.when(F.col("l_linenumber") % 3 == 2, F.concat(_pick(HEADS, F.col("l_suppkey") % len(HEADS)), F.lit("\n"), body)).otherwise(body)
    rows = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", text.alias("t")))).alias("r"))
    name = F.concat(F.lit("src/o"), F.col("l_orderkey"), _pick(ENDINGS, F.col("l_orderkey") % len(ENDINGS)))
    return rows.select(F.col("l_orderkey").alias("ord"), name.alias("filename"), F.array_join(F.transform("r", lambda x: x["t"]), "\n").alias("patch"))


_PATCH_SQL = f"""
b AS (SELECT *, CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE ' ' END || {_list(LINES)}[l_partkey % {len(LINES)} + 1] AS body FROM lineitem),
x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, CASE WHEN l_linenumber % 3 = 2 THEN {_list(HEADS)}[l_suppkey % {len(HEADS)} + 1] || chr(10) || body ELSE body END AS t FROM b),
p AS (SELECT l_orderkey, 'src/o' || l_orderkey || {_list(ENDINGS)}[l_orderkey % {len(ENDINGS)} + 1] AS file, string_agg(t, chr(10) ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS patch FROM x GROUP BY l_orderkey),
s AS (SELECT file, string_split(patch, chr(10)) AS ls FROM p),
l AS (SELECT file, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM s),
h AS (SELECT *, regexp_extract(line, '@@ -(\\d+),?(\\d*) \\+(\\d+),?(\\d*) @@(.*)', ['a', 'b', 'c', 'd', 'e']) AS g, starts_with(line, '@@') AS head FROM l),
k AS (SELECT *, sum(head::INT) OVER (PARTITION BY file ORDER BY pos) - 1 AS hunk FROM h),
w AS (SELECT *, max(CASE WHEN head THEN TRY_CAST(g.c AS INT) END) OVER (PARTITION BY file, hunk) AS start FROM k),
d AS (SELECT file, hunk, pos, CASE WHEN starts_with(line, '+') THEN 'add' WHEN starts_with(line, '-') THEN 'delete' ELSE 'context' END AS type, substring(line, 2) AS content, start FROM w WHERE NOT head AND hunk >= 0 AND line <> ''),
n AS (SELECT *, row_number() OVER q - 1 AS idx, CASE WHEN type = 'delete' THEN -1 ELSE start + coalesce(sum((type <> 'delete')::INT) OVER (PARTITION BY file, hunk ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS number
      FROM d WINDOW q AS (PARTITION BY file, hunk ORDER BY pos))
"""


def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every patch with its hunk, type and number in the new file."""
    return diff.lines(_patches(spark, sf_dir))


DIFF_LINES_SQL = f"""
WITH {_PATCH_SQL}
SELECT file, hunk::INT AS hunk_id, idx::INT AS idx, type, number::INT AS line_number, content, {_any("content", pred.KEY_CHANGE)} AS is_key FROM n
"""


def diff_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of all hunks with what they stand in."""
    return diff.hunks(_patches(spark, sf_dir))


DIFF_HUNKS_SQL = f"""
WITH {_PATCH_SQL}
SELECT file, hunk::INT AS hunk_id, TRY_CAST(g.a AS INT) AS old_start, CASE WHEN g.b = '' THEN 1 ELSE TRY_CAST(g.b AS INT) END AS old_lines, TRY_CAST(g.c AS INT) AS new_start, CASE WHEN g.d = '' THEN 1 ELSE TRY_CAST(g.d AS INT) END AS new_lines,
  CASE WHEN contains(g.e, 'function ') THEN 'main' WHEN contains(g.e, 'class ') THEN 'Order' WHEN contains(g.e, 'const ') THEN 'total' END AS semantic_context FROM k WHERE head
"""


def diff_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports, exports, outside dependencies and declared names of a file's changed lines."""
    lines = diff.lines(_patches(spark, sf_dir))
    row = lambda df, kind, change, what: df.select("file", F.lit(kind).alias("kind"), change.alias("change"), what.alias("what"))
    imports = diff.import_changes(lines)
    out = row(imports, "import", F.col("type"), F.concat_ws(" from ", F.array_join("items", ","), "module"))
    exports = diff.export_changes(lines)
    out = out.unionByName(row(exports, "export", F.col("type"), F.concat_ws(" ", "export_type", "name"))).unionByName(row(diff.dependencies(imports), "dependency", F.lit("added"), F.col("module")))
    return out.groupBy("file", "kind", "change", "what").agg(F.count(F.lit(1)).alias("n"))


_IMPORTS = {LINES[0]: ("useA,useB", "./part"), LINES[1]: ("React", "react"), LINES[2]: ("* as * as all", "lib/all"), LINES[13]: ("x", "react")}
_EXPORTS = {LINES[3]: "named total", LINES[4]: "default function", LINES[12]: "named Kind"}


def _value(table: dict, pick) -> str:
    return "CASE content " + " ".join("WHEN '" + k.replace("'", "''") + "' THEN '" + pick(v).replace("'", "''") + "'" for k, v in table.items()) + " END"


DIFF_CHANGES_SQL = f"""
WITH {_PATCH_SQL},
c AS (SELECT file, CASE type WHEN 'add' THEN 'added' ELSE 'removed' END AS change, {_value(_IMPORTS, lambda v: f"{v[0]} from {v[1]}")} AS i, {_value(_IMPORTS, lambda v: v[1])} AS m, {_value(_EXPORTS, lambda v: v)} AS e FROM n WHERE type <> 'context'),
a AS (SELECT file, 'import' AS kind, change, i AS what FROM c WHERE i IS NOT NULL UNION ALL SELECT file, 'export', change, e FROM c WHERE e IS NOT NULL
      UNION ALL SELECT DISTINCT file, 'dependency', 'added', m FROM c WHERE change = 'added' AND NOT starts_with(m, '.'))
SELECT file, kind, change, what, count(*) AS n FROM a GROUP BY ALL
"""


def merged_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one customer that bear one name (by ending): the first one's columns, all patches in order."""
    p = _patches(spark, sf_dir).join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), "o_custkey"), "ord")
    named = p.withColumn("file", F.concat_ws("/", F.col("o_custkey").cast("string"), F.regexp_extract("filename", r"[.].*$", 0)))
    merged = relational.merge_files(named.select("file", "ord", "filename", "patch"), "file", "ord", "patch")
    return merged.select("file", "ord", "filename", F.md5("patch").alias("patch"))


MERGED_SQL = f"""
WITH {_PATCH_SQL}, o AS (SELECT o_custkey || '/' || regexp_extract(file, '[.].*$', 0) AS name, l_orderkey, file AS filename, patch FROM p JOIN orders ON o_orderkey = l_orderkey)
SELECT name AS file, min(l_orderkey) AS ord, arg_min(filename, l_orderkey) AS filename, md5(string_agg(patch, chr(10) ORDER BY l_orderkey)) AS patch FROM o GROUP BY name
"""


RELATIONS = ("uses", "modifies", "depends-on", "shared-utility", "related-feature", "other")


def best_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a customer's lines as references, by ship status and size of kinds that differ in weight: one each, the five
    most specific of a customer, both ways, with the target's name."""
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    place = ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")) * 2_000 + F.col("l_suppkey")
    refs = rows.select(
        F.concat(F.lit("c"), F.col("o_custkey")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("dst"), _pick(RELATIONS, F.col("l_partkey") % len(RELATIONS)).alias("relationship"),
        F.col("l_linestatus").alias("context"), F.lit(True).alias("bidirectional"), F.struct(place.alias("place"), F.isnull("l_linestatus").alias("none"), F.col("l_linestatus").alias("least")).alias("ord"),
    )
    best = crossref.optimised(refs, 5)  # of rows at one place the least context counts, as a null only if all are
    both = crossref.both_ways(best.select(*crossref.REF))
    nodes = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"))
    nodes = nodes.unionByName(read(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), F.col("c_name").alias("name")))
    return crossref.targets(both, nodes)


REFERENCES_SQL = f"""
WITH r AS (SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst, {_list(RELATIONS)}[l_partkey % {len(RELATIONS)} + 1] AS relationship, min(l_linestatus) AS context, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 2000 + l_suppkey AS ord FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY src, dst, relationship ORDER BY ord) = 1),
b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY src ORDER BY CASE relationship WHEN 'modifies' THEN 5 WHEN 'depends-on' THEN 4 WHEN 'uses' THEN 3 WHEN 'shared-utility' THEN 2 WHEN 'related-feature' THEN 1 ELSE 0 END DESC, ord) <= 5),
w AS (SELECT src, dst, relationship, context FROM b UNION ALL SELECT dst, src, CASE relationship WHEN 'uses' THEN 'used-by' WHEN 'modifies' THEN 'modified-by' WHEN 'depends-on' THEN 'dependency-of' ELSE relationship END, context FROM b),
n AS (SELECT 's' || s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT 'c' || c_custkey, c_name FROM customer WHERE c_custkey % 3 > 0)
SELECT src, dst, relationship, context, true AS bidirectional, name AS target_name FROM w JOIN n ON n.id = w.dst
"""

QUERIES = {f.__name__: f for f in (diff_lines, diff_hunks, diff_changes, merged_patches, best_references)}
ORACLES = dict(zip(QUERIES, (DIFF_LINES_SQL, DIFF_HUNKS_SQL, DIFF_CHANGES_SQL, MERGED_SQL, REFERENCES_SQL), strict=True))
