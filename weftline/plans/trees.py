"""Hierarchy queries: region, nation, customer, order as a forest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tree
from .tables import read


def _nodes(spark: SparkSession, sf_dir: str, leaves: str) -> DataFrame:
    """id, parent_id, depth, n, amount: regions, nations and (customers, orders) or (suppliers)."""
    node = lambda df, id_, parent, depth, n=F.lit(0), amount=F.lit(0.0): df.select(id_.alias("id"), parent.alias("parent_id"), F.lit(depth).alias("depth"), n.alias("n"), amount.alias("amount"))
    key = lambda prefix, col: F.concat(F.lit(prefix), F.col(col).cast("string"))
    out = node(read(spark, sf_dir, "region"), key("r", "r_regionkey"), F.lit(None).cast("string"), 0)
    out = out.unionByName(node(read(spark, sf_dir, "nation"), key("n", "n_nationkey"), key("r", "n_regionkey"), 1))
    if leaves == "supplier":
        return out.unionByName(node(read(spark, sf_dir, "supplier"), key("s", "s_suppkey"), key("n", "s_nationkey"), 2, F.lit(1), F.col("s_acctbal")))
    out = out.unionByName(node(read(spark, sf_dir, "customer"), key("c", "c_custkey"), key("n", "c_nationkey"), 2))
    return out.unionByName(node(read(spark, sf_dir, "orders"), key("o", "o_orderkey"), key("c", "o_custkey"), 3, F.lit(1), F.col("o_totalprice")))


def tree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their value below every region, nation and customer."""
    totals = tree.rollup(_nodes(spark, sf_dir, "orders"), 3, {"n": F.col("n").cast("long"), "amount": F.col("amount")})
    return totals.where("depth < 3").select("id", "depth", "n", F.round("amount", 2).alias("amount"))


ROLLUP_SQL = """
WITH o AS (SELECT o_custkey, c_nationkey, n_regionkey, o_totalprice AS p FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
SELECT 'c' || c_custkey AS id, 2 AS depth, count(p) AS n, round(coalesce(sum(p), 0), 2) AS amount FROM customer LEFT JOIN o ON o_custkey = c_custkey GROUP BY c_custkey
UNION ALL SELECT 'n' || k.n_nationkey, 1, count(p), round(coalesce(sum(p), 0), 2) FROM nation k LEFT JOIN o ON c_nationkey = k.n_nationkey GROUP BY k.n_nationkey
UNION ALL SELECT 'r' || r_regionkey, 0, count(p), round(coalesce(sum(p), 0), 2) FROM region LEFT JOIN o ON n_regionkey = r_regionkey GROUP BY r_regionkey
"""


def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted pre-order numbers of region, nation and supplier."""
    nodes = _nodes(spark, sf_dir, "supplier")
    nodes = tree.numbered(nodes, [F.length("id"), F.col("id")])
    return tree.levels(nodes).select("id", "depth", "path")


PATHS_SQL = """
WITH r AS (SELECT r_regionkey AS k, row_number() OVER (ORDER BY r_regionkey) AS i FROM region),
n AS (SELECT n_nationkey AS k, n_regionkey AS p, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation),
s AS (SELECT s_suppkey AS k, s_nationkey AS p, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier)
SELECT 'r' || k AS id, 0 AS depth, CAST(i AS VARCHAR) AS path FROM r
UNION ALL SELECT 'n' || n.k, 1, r.i || '.' || n.i FROM n JOIN r ON r.k = n.p
UNION ALL SELECT 's' || s.k, 2, r.i || '.' || n.i || '.' || s.i FROM s JOIN n ON n.k = s.p JOIN r ON r.k = n.p
"""


def tree_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, depths and means over the supplier forest."""
    nodes = _nodes(spark, sf_dir, "supplier")
    forest = tree.levels(tree.numbered(nodes, [F.length("id"), F.col("id")])).join(nodes.select("id", "n", "amount"), "id")
    kids = nodes.groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("kids"))
    forest = forest.join(kids, "id", "left").withColumn("kids", F.coalesce("kids", F.lit(0)))
    stats = tree.forest_stats(forest, F.when(F.col("depth") == 1, "merge").otherwise("single"), F.col("kids"), F.col("kids") > 0, F.when(F.col("depth") == 2, 0.5).otherwise(1.0))
    return stats.select("n_nodes", F.col("max_depth"), F.round("mean_depth", 6).alias("mean_depth"), "n_expanded", "n_merged", F.round("mean_confidence", 6).alias("mean_confidence"))


STATISTICS_SQL = """
WITH t AS (SELECT 0 AS depth, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS kids FROM region
  UNION ALL SELECT 1, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) FROM nation UNION ALL SELECT 2, 0 FROM supplier)
SELECT count(*) AS n_nodes, max(depth) AS max_depth, round(avg(depth), 6) AS mean_depth, count(*) FILTER (kids > 0) AS n_expanded, count(*) FILTER (depth = 1 AND kids > 1) AS n_merged,
  round(avg(CASE WHEN depth = 2 THEN 0.5 ELSE 1.0 END), 6) AS mean_confidence FROM t
"""


def domain_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation grouped by segment; a segment of two or more gets a parent."""
    c = read(spark, sf_dir, "customer").withColumn("domain", F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment"))
    return tree.parents_for_groups(c, "domain", "c_custkey").select("domain", "n", "first", "parent_id", "level")


HIERARCHY_SQL = """
WITH g AS (SELECT c_nationkey || '/' || c_mktsegment AS domain, count(*) AS n, min(c_custkey) AS first FROM customer GROUP BY ALL)
SELECT domain, n, first, CASE WHEN n >= 2 THEN 'parent-' || domain END AS parent_id, CASE WHEN n >= 2 THEN 1 ELSE 0 END AS level FROM g
"""

QUERIES = {f.__name__: f for f in (tree_rollup, tree_paths, tree_statistics, domain_hierarchy)}
ORACLES = dict(zip(QUERIES, (ROLLUP_SQL, PATHS_SQL, STATISTICS_SQL, HIERARCHY_SQL), strict=True))
