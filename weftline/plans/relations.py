"""Related nodes and the groups they form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster, crossref
from ..operators.relational import small
from .tables import read


def related_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as nodes: named by nation and account, files in folders of their nation, seven words of context; every
    related pair with the leaders of its two groups."""
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    word = lambda times, size: F.concat(F.lit("w"), (k * times % size).cast("string"))
    nodes = s.select(
        k.cast("string").alias("id"), k.alias("ord"), F.concat(F.lit("Nation"), F.col("s_nationkey"), F.lit(" Sub"), k % 7, F.lit("  "), F.col("s_name")).alias("name"),
        F.array(F.concat(F.lit("n"), F.col("s_nationkey"), F.lit("/"), k % 5, F.lit("/a.ts")), F.concat(F.lit("own/"), k, F.lit("/b.ts"))).alias("affected_files"),
        F.concat_ws(" ", word(7, 50), word(13, 60), word(1, 40), word(3, 45), F.lit("common"), F.concat(F.lit("u"), k), F.concat(F.lit("v"), k)).alias("context"),
    )
    leader = cluster.stored(crossref.related_groups(nodes))
    pairs = crossref.related(nodes.join(small(leader, 1_000_000), "ord"), carry=["leader"])
    return pairs.select("a", "b", "context", F.col("leader").alias("leader_a"), F.col("leader2").alias("leader_b"))


RELATED_SQL = """
WITH RECURSIVE n AS (SELECT s_suppkey AS k, 'n' || s_nationkey || '/' || s_suppkey % 5 AS dir, list_distinct(string_split_regex(lower('Nation' || s_nationkey || ' Sub' || s_suppkey % 7 || '  ' || s_name), '\\s+')) AS names,
    list_distinct(['w' || s_suppkey * 7 % 50, 'w' || s_suppkey * 13 % 60, 'w' || s_suppkey % 40, 'w' || s_suppkey * 3 % 45, 'common', 'u' || s_suppkey, 'v' || s_suppkey]) AS words, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier),
c AS (SELECT x.k AS a, y.k AS b, CASE WHEN x.dir = y.dir THEN 'Work on related files' WHEN len(list_intersect(x.names, y.names)) >= 2 THEN 'Similar functionality'
        WHEN len(list_intersect(x.words, y.words)) / least(len(x.words), len(y.words)) > 0.3::DOUBLE THEN 'Related implementation' END AS context FROM n x JOIN n y ON x.k < y.k),
p AS (SELECT * FROM c WHERE context IS NOT NULL),
near AS (SELECT n.i, n.k, coalesce(list(p.b) FILTER (p.b IS NOT NULL), []) AS l FROM n LEFT JOIN p ON p.a = n.k GROUP BY n.i, n.k),
g AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS leader, []::BIGINT[] AS won, []::BIGINT[] AS gone
  UNION ALL SELECT near.i, CASE WHEN list_contains(gone, k) THEN NULL ELSE k END, CASE WHEN list_contains(gone, k) THEN [] ELSE list_filter(l, lambda x: NOT list_contains(gone, x)) END,
    CASE WHEN list_contains(gone, k) THEN gone ELSE list_concat(gone, list_append(l, k)) END FROM g JOIN near ON near.i = g.i + 1),
m AS (SELECT leader AS k, leader FROM g WHERE leader IS NOT NULL UNION ALL SELECT unnest(won), leader FROM g WHERE leader IS NOT NULL)
SELECT a, b, context, x.leader AS leader_a, y.leader AS leader_b FROM p JOIN m x ON x.k = a JOIN m y ON y.k = b
"""

QUERIES = {"related_nodes": related_nodes}
ORACLES = {"related_nodes": RELATED_SQL}
