"""Review queries: orders stand for issues, customers for review nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.base import lookup
from ..operators import review
from .tables import read

SEVERITY = {"1": "critical", "2": "major", "3": "minor"}
SEVERITY_SQL = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'major' WHEN '3' THEN 'minor' ELSE 'suggestion' END"


def severity(priority: Column) -> Column:
    return lookup(F.substring(priority, 1, 1), SEVERITY, "suggestion")


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").withColumn("severity", severity(F.col("o_orderpriority")))


def review_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = issues(spark, sf_dir).select(
        "o_custkey", (F.col("severity") == "critical").cast("int").alias("_c"), (F.col("severity") == "major").cast("int").alias("major"),
        F.when(F.col("o_totalprice") > 400000, "high").when(F.col("o_totalprice") > 200000, "medium").otherwise("low").alias("risk_level"),
        F.when(F.col("o_orderstatus") == "P", 0.5).otherwise(0.8).alias("confidence"), "o_totalprice",
    )
    nodes = nodes.withColumn("critical", F.when(F.col("o_totalprice") > 300000, F.col("_c")).otherwise(0))
    return review.recommend(nodes, ["o_custkey"])


RECOMMENDATION_SQL = f"""
WITH n AS (SELECT o_custkey, {SEVERITY_SQL} AS s, o_totalprice AS p, o_orderstatus AS st FROM orders),
g AS (SELECT o_custkey, count(*) AS n_nodes, count(*) FILTER (s = 'critical' AND p > 300000) AS critical_nodes, count(*) FILTER (p > 400000) AS high_risk_nodes,
      count(*) FILTER (s = 'major') AS major_nodes, count(*) FILTER (st = 'P') AS low_confidence_nodes FROM n GROUP BY o_custkey)
SELECT *, CASE WHEN critical_nodes > 0 OR high_risk_nodes > 0 THEN 'request-changes' WHEN major_nodes > 2 OR low_confidence_nodes > n_nodes / 2 THEN 'needs-discussion' ELSE 'approve' END AS recommendation FROM g
"""


def review_summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    agg = issues(spark, sf_dir).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), *review.severity_counts(F.col("severity")), F.round(F.avg("o_totalprice"), 6).alias("mean_price"))
    return agg


SUMMARY_SQL = f"""
SELECT o_orderstatus, count(*) AS n, count(*) FILTER ({SEVERITY_SQL} = 'critical') AS critical, count(*) FILTER ({SEVERITY_SQL} = 'major') AS major,
       count(*) FILTER ({SEVERITY_SQL} = 'minor') AS minor, count(*) FILTER ({SEVERITY_SQL} = 'suggestion') AS suggestion, round(avg(o_totalprice), 6) AS mean_price
FROM orders GROUP BY o_orderstatus
"""


def action_items_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = review.action_items(issues(spark, sf_dir), "o_custkey", "o_orderkey")
    names = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    per = items.groupBy("o_custkey").agg(F.count_if(F.col("severity") == "critical").alias("_c"), F.count_if(F.col("severity") == "major").alias("_m"))
    loud = per.where((F.col("_c") > 0) | (F.col("_m") >= 2)).select("o_custkey")
    return items.join(loud, "o_custkey", "left_semi").join(names, "o_custkey").select("o_custkey", "c_name", "o_orderkey", "severity", "priority", F.col("rank").cast("long").alias("rank"))


ACTION_SQL = f"""
WITH i AS (SELECT o_custkey, o_orderkey, {SEVERITY_SQL} AS severity FROM orders),
a AS (SELECT *, CASE severity WHEN 'critical' THEN 1 ELSE 2 END AS priority FROM i WHERE severity IN ('critical', 'major')),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY priority, o_orderkey) AS rank,
      count(*) FILTER (severity = 'critical') OVER (PARTITION BY o_custkey) AS c, count(*) FILTER (severity = 'major') OVER (PARTITION BY o_custkey) AS m FROM a)
SELECT o_custkey, c_name, o_orderkey, severity, priority, rank FROM r JOIN customer ON c_custkey = o_custkey WHERE c > 0 OR m >= 2
"""


def risk_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    risk = F.when(F.col("o_totalprice") > 400000, 4).when(F.col("o_totalprice") > 300000, 3).when(F.col("o_totalprice") > 150000, 2).otherwise(1)
    leaf = issues(spark, sf_dir).select("o_custkey", risk.alias("risk"), F.lit(1).alias("n"))
    leaf = leaf.join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nationkey")), "o_custkey")
    leaf = leaf.groupBy("o_custkey", "nationkey").agg(F.max("risk").alias("risk"), F.sum("n").alias("n"))
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nationkey"), F.col("n_regionkey").alias("regionkey"))
    leaf = leaf.join(nations, "nationkey")
    return reduce(DataFrame.unionByName, review.risk_rollup(leaf, ["o_custkey", "nationkey", "regionkey"], "risk"))


RISK_SQL = """
WITH l AS (SELECT o_custkey, c_nationkey AS nationkey, n_regionkey AS regionkey,
  CASE WHEN o_totalprice > 400000 THEN 4 WHEN o_totalprice > 300000 THEN 3 WHEN o_totalprice > 150000 THEN 2 ELSE 1 END AS r
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
SELECT 'o_custkey' AS level, CAST(o_custkey AS VARCHAR) AS key, max(r) AS risk, count(*) AS n FROM l GROUP BY o_custkey
UNION ALL SELECT 'nationkey', CAST(nationkey AS VARCHAR), max(r), count(*) FROM l GROUP BY nationkey
UNION ALL SELECT 'regionkey', CAST(regionkey AS VARCHAR), max(r), count(*) FROM l GROUP BY regionkey
"""


def confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    both = read(spark, sf_dir, "labels").join(docs, "doc_id", "left")
    c = review.review_confidence(F.col("n_chars") > 500, F.col("quality") == 0, F.col("quality") == 1, F.col("lang") == "en", F.col("toxic") == 1, F.col("n_chars") > 5000)
    return both.select("doc_id", F.round(c, 6).alias("confidence"), review.ttl_factor(c).alias("ttl_factor"))


CONFIDENCE_SQL = """
WITH c AS (SELECT l.doc_id, greatest(0.1::DOUBLE, least(1.0::DOUBLE,
  0.5::DOUBLE + (CASE WHEN n_chars > 500 THEN 0.2 ELSE 0 END)::DOUBLE + (CASE WHEN quality = 0 THEN 0.1 ELSE 0 END)::DOUBLE + (CASE WHEN quality = 1 THEN 0.1 ELSE 0 END)::DOUBLE
  + (CASE WHEN lang = 'en' THEN 0.1 ELSE 0 END)::DOUBLE - (CASE WHEN toxic = 1 THEN 0.2 WHEN n_chars > 5000 THEN 0.1 ELSE 0 END)::DOUBLE)) AS c
  FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id)
SELECT doc_id, round(c, 6) AS confidence, (CASE WHEN c >= 0.9::DOUBLE THEN 4.0 WHEN c >= 0.7::DOUBLE THEN 2.0 WHEN c >= 0.5::DOUBLE THEN 1.0 ELSE 0.5 END)::DOUBLE AS ttl_factor FROM c
"""

QUERIES = {
    "review_recommendation": review_recommendation, "review_summary_counts": review_summary_counts, "action_items_ranked": action_items_ranked,
    "risk_rollup": risk_rollup, "confidence_score": confidence_score,
}
ORACLES = {
    "review_recommendation": RECOMMENDATION_SQL, "review_summary_counts": SUMMARY_SQL, "action_items_ranked": ACTION_SQL, "risk_rollup": RISK_SQL, "confidence_score": CONFIDENCE_SQL,
}
