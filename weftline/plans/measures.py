"""Metric, window and state queries over events and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, ordered, state
from .tables import read


def _micros(col: str):
    return F.unix_micros(F.col(col).cast("timestamp"))


def depth_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact report by depth (line number) and complexity (line status)."""
    li = read(spark, sf_dir, "lineitem")
    rep = metrics.group_report(li, ["l_linenumber", "l_linestatus"], F.col("l_returnflag") == "R", F.col("l_returnflag") == "A", F.col("l_discount") + 0.0, F.col("l_quantity"))
    return rep.select("l_linenumber", "l_linestatus", "n", *[F.round(c, 6).alias(c) for c in ("expansion_rate", "correction_rate", "mean_confidence", "mean_ms")])


DEPTH_SQL = """
SELECT l_linenumber, l_linestatus, count(*) AS n, round(avg((l_returnflag = 'R')::INT), 6) AS expansion_rate, round(avg((l_returnflag = 'A')::INT), 6) AS correction_rate,
       round(avg(l_discount + 0.0), 6) AS mean_confidence, round(avg(l_quantity), 6) AS mean_ms
FROM lineitem GROUP BY ALL
"""


def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10 + 0.0).alias("discount"), (F.col("l_tax") * 10 + 0.0).alias("tax"))
    return metrics.score_histogram(li, ["discount", "tax"])


HISTOGRAM_SQL = """
WITH u AS (SELECT 'discount' AS score, l_discount * 10 + 0.0 AS v FROM lineitem UNION ALL SELECT 'tax', l_tax * 10 + 0.0 FROM lineitem)
SELECT score, CASE WHEN v < 0.2::DOUBLE THEN '0.0-0.2' WHEN v < 0.4::DOUBLE THEN '0.2-0.4' WHEN v < 0.6::DOUBLE THEN '0.4-0.6' WHEN v < 0.8::DOUBLE THEN '0.6-0.8' ELSE '0.8-1.0' END AS bucket, count(*) AS n
FROM u GROUP BY ALL
"""


def score_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, upper median and range of four scores, unpivoted."""
    li = read(spark, sf_dir, "lineitem").select(*[(F.col(f"l_{c}") + 0.0).alias(c) for c in ("quantity", "extendedprice", "discount", "tax")])
    rep = metrics.score_report(li, ["quantity", "extendedprice", "discount", "tax"])
    return rep.select("score", "n", F.round("mean", 6).alias("mean"), "low", "high", "median")


STATISTICS_SQL = """
WITH u AS (SELECT 'quantity' AS score, l_quantity + 0.0 AS v FROM lineitem UNION ALL SELECT 'extendedprice', l_extendedprice + 0.0 FROM lineitem
           UNION ALL SELECT 'discount', l_discount + 0.0 FROM lineitem UNION ALL SELECT 'tax', l_tax + 0.0 FROM lineitem)
SELECT score, count(*) AS n, round(avg(v), 6) AS mean, min(v) AS low, max(v) AS high, list_sort(list(v))[CAST(floor(0.5 * count(*)) AS INT) + 1] AS median FROM u GROUP BY score
"""


def rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.value_at_rank(read(spark, sf_dir, "events"), ["event_type"], "value", {"median": 0.5, "p95": 0.95})


PERCENTILE_SQL = """
SELECT event_type, list_sort(list(value))[CAST(floor(0.5 * count(value)) AS INT) + 1] AS median, list_sort(list(value))[CAST(floor(0.95 * count(value)) AS INT) + 1] AS p95
FROM events GROUP BY event_type
"""


def slowest_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k report: the five slowest."""
    return read(spark, sf_dir, "events").select("event_id", "event_type", "value").orderBy(F.desc("value"), "event_id").limit(5)


SLOWEST_SQL = "SELECT event_id, event_type, value FROM events ORDER BY value DESC, event_id LIMIT 5"


def newest_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return ordered.newest_share(ev, ["ts", "event_id"], F.floor(_micros("ts") / 3_600_000_000), 0.8).select("event_id", "event_type")


NEWEST_SQL = """
SELECT event_id, event_type FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER () AS n FROM events) WHERE r <= floor(n * 0.8)
"""


def moving_hit_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events")
    rows = ev.select("event_id", "user_id", ordered.moving_average("value", ["user_id"], ["ts", "event_id"], 100).alias("age"), F.count(F.lit(1)).over(ordered.last_rows(["user_id"], ["ts", "event_id"], 100)).alias("n"))
    # the mean times its count: a sum of cents, which rounds without ties
    return rows.select("event_id", "user_id", "n", F.round(F.col("age") * F.col("n"), 2).alias("age_sum"))


MOVING_SQL = "SELECT event_id, user_id, count(*) OVER w AS n, round(sum(value) OVER w, 2) AS age_sum FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"


def stage_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_extendedprice").alias("ms"))
    rep = metrics.stage_shares(li, "l_orderkey", "ms")
    return rep.select("l_orderkey", "l_partkey", F.round("share", 6).alias("share"), "bottleneck")


STAGE_SQL = """
WITH s AS (SELECT l_orderkey, l_partkey, sum(l_extendedprice) AS ms FROM lineitem GROUP BY ALL),
t AS (SELECT *, ms / sum(ms) OVER (PARTITION BY l_orderkey) AS share FROM s)
SELECT l_orderkey, l_partkey, round(share, 6) AS share, share > 0.7::DOUBLE AS bottleneck FROM t
"""


def call_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events").withColumn("ms", F.col("value") * 100)
    rep = metrics.call_report(ev, "event_type", "ms", "event_id")
    return rep.select("event_type", "n", F.round("mean_ms", 6).alias("mean_ms"), "max_ms", "slowest", "n_slow", F.round("share", 6).alias("share"))


CALL_SQL = """
WITH c AS (SELECT *, value * 100 AS ms FROM events)
SELECT event_type, count(*) AS n, round(avg(ms), 6) AS mean_ms, max(ms) AS max_ms, arg_max(event_id, {'a': ms, 'b': event_id}) AS slowest, count(*) FILTER (ms > 5000) AS n_slow,
       round(sum(ms) / (SELECT sum(ms) FROM c), 6) AS share FROM c GROUP BY event_type
"""


def error_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = ordered.islands(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")
    return runs.groupBy("length").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("length") >= 5).alias("trips"))


ISLANDS_SQL = """
WITH m AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
r AS (SELECT user_id, island, count(*) AS length FROM m WHERE event_type = 'error' GROUP BY ALL)
SELECT length, count(*) AS runs, count(*) FILTER (length >= 5) AS trips FROM r GROUP BY length
"""


def lru_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = read(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last"), F.count(F.lit(1)).alias("size"))
    gone = ordered.evicted(last, ["last", "user_id"], F.floor(_micros("last") / 3_600_000_000), "size", 1000)
    return gone.select("user_id", "size")


EVICTION_SQL = """
WITH l AS (SELECT user_id, max(ts) AS last, count(*) AS size FROM events GROUP BY user_id),
r AS (SELECT *, sum(size) OVER (ORDER BY last, user_id) - size AS before FROM l)
SELECT user_id, size FROM r WHERE before < 1000
"""


def queue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events")
    step = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", -1).otherwise(0)
    run = ordered.running(ev, step, [F.col("ts"), F.col("event_id")], F.floor(_micros("ts") / 3_600_000_000), name="depth")
    return run.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.max("depth").alias("max_depth"), F.min("depth").alias("min_depth"))


QUEUE_SQL = """
WITH r AS (SELECT ts, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) OVER (ORDER BY ts, event_id) AS depth FROM events)
SELECT strftime(ts, '%Y-%m-%d') AS day, max(depth)::BIGINT AS max_depth, min(depth)::BIGINT AS min_depth FROM r GROUP BY ALL
"""


def ttl_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (_micros("ts")).alias("at"))
    found = state.ttl_hits(ev, ["user_id", "event_type"], "at", "event_id", 3_600_000_000)
    return found.select("event_id", "hit")


TTL_SQL = """
WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT event_id, user_id, event_type, us, i, false AS hit, us AS stored FROM e WHERE i = 1
      UNION ALL SELECT e.event_id, e.user_id, e.event_type, e.us, e.i, e.us - f.stored <= 3600000000, CASE WHEN e.us - f.stored <= 3600000000 THEN f.stored ELSE e.us END
      FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.i = f.i + 1)
SELECT event_id, hit FROM f
"""


def cache_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: requests, hits and hit rate of those with over ten requests."""
    ev = read(spark, sf_dir, "events")
    rep = metrics.cache_report(ev, "user_id", F.col("event_type") == "view", F.col("value"))
    return rep.select("user_id", "requests", "hits", F.round("mean_age", 6).alias("mean_age"), F.round("hit_rate", 6).alias("hit_rate"))


CACHE_SQL = """
SELECT user_id, count(*) AS requests, count(*) FILTER (event_type = 'view') AS hits, round(avg(value) FILTER (event_type = 'view'), 6) AS mean_age,
       round(count(*) FILTER (event_type = 'view') / count(*), 6) AS hit_rate FROM events GROUP BY user_id HAVING count(*) > 10
"""


def variance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    scores = [F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_extendedprice") / 100000]
    v = F.round(metrics.population_variance(*scores), 6)
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.count_if(v > 0.1).alias("checked"), F.round(F.avg(v), 5).alias("mean_variance"))


VARIANCE_SQL = """
WITH s AS (SELECT l_returnflag, l_linestatus, l_quantity / 50 AS a, l_discount * 10 AS b, l_tax * 10 AS c, l_extendedprice / 100000 AS d FROM lineitem),
m AS (SELECT *, (a + b + c + d) / 4 AS u FROM s),
v AS (SELECT l_returnflag, l_linestatus, round(((a - u) * (a - u) + (b - u) * (b - u) + (c - u) * (c - u) + (d - u) * (d - u)) / 4, 6) AS v FROM m)
SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (v > 0.1::DOUBLE) AS checked, round(avg(v), 5) AS mean_variance FROM v GROUP BY ALL
"""

QUERIES = {f.__name__: f for f in (depth_report, score_histogram, score_statistics, rank_percentiles, slowest_topk, newest_retained, moving_hit_age, stage_share, call_report, error_islands, lru_eviction, queue_depth, ttl_cache_hits, cache_efficiency, variance_gate)}
ORACLES = dict(zip(QUERIES, (DEPTH_SQL, HISTOGRAM_SQL, STATISTICS_SQL, PERCENTILE_SQL, SLOWEST_SQL, NEWEST_SQL, MOVING_SQL, STAGE_SQL, CALL_SQL, ISLANDS_SQL, EVICTION_SQL, QUEUE_SQL, TTL_SQL, CACHE_SQL, VARIANCE_SQL), strict=True))
