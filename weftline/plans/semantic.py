"""Semantic lookup and invalidation queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..operators import semantic
from .tables import read


def semantic_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even documents are answers stored at the time of their number, which live for 100 to 800 numbers by length;
    odd ones ask. The context is the language, the exact key the first 40 characters."""
    d = read(spark, sf_dir, "documents").where("text is not null and lang is not null").withColumn("tokens", sim.semantic_tokens(F.col("text")))
    key, at = F.substring("text", 1, 40).alias("key"), F.col("doc_id").alias("at")
    stores = d.where("doc_id % 2 = 0").select(F.col("lang").alias("context"), key, at, (F.lit(100) + F.col("n_chars") % 701).cast("long").alias("ttl"), F.col("doc_id").alias("seq"), "tokens")
    lookups = d.where("doc_id % 2 = 1").select(F.col("doc_id").alias("lookup"), F.col("lang").alias("context"), key, at, "tokens")
    return semantic.found(lookups, stores).select("lookup", "kind", "store", F.round("similarity", 9).alias("similarity"))


LOOKUP_SQL = rf"""
WITH d AS (SELECT doc_id, lang, left(text, 40) AS key, 100 + n_chars % 701 AS ttl,
             list_sort(list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^\w\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 2 AND NOT list_contains([{", ".join(f"'{w}'" for w in sim.STOP_WORDS)}], w)))) AS t
           FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL),
v AS (SELECT *, doc_id + ttl AS ends, lead(doc_id) OVER k AS next, coalesce(lag(doc_id + ttl) OVER k, -1) < doc_id AS new FROM d WHERE doc_id % 2 = 0 WINDOW k AS (PARTITION BY lang, key ORDER BY doc_id)),
c AS (SELECT *, least(ends, coalesce(next - 1, ends)) AS until, sum(new::INT) OVER (PARTITION BY lang, key ORDER BY doc_id) AS chain FROM v),
s AS (SELECT *, min(doc_id) OVER (PARTITION BY lang, key, chain) AS place FROM c),
l AS (SELECT * FROM d WHERE doc_id % 2 = 1),
e AS (SELECT l.doc_id AS lookup, max(s.doc_id) AS store FROM l JOIN s ON s.lang = l.lang AND s.key = l.key AND s.doc_id <= l.doc_id AND l.doc_id <= s.until GROUP BY 1),
p AS (SELECT l.doc_id AS lookup, s.doc_id AS store, s.place, len(list_intersect(l.t, s.t)) AS common, len(l.t) + len(s.t) AS total
      FROM l JOIN s ON s.lang = l.lang AND s.doc_id <= l.doc_id AND l.doc_id <= s.until WHERE least(len(l.t), len(s.t)) >= 0.84 * greatest(len(l.t), len(s.t)) AND len(l.t) > 0),
m AS (SELECT lookup, arg_min({{'store': store, 'similarity': common / (total - common)}}, {{'a': place, 'b': store}}) AS b FROM p WHERE common / (total - common) >= 0.85::DOUBLE AND lookup NOT IN (SELECT lookup FROM e) GROUP BY lookup)
SELECT l.doc_id AS lookup, CASE WHEN e.store IS NOT NULL THEN 'exact' WHEN m.b IS NOT NULL THEN 'semantic' ELSE 'miss' END AS kind, coalesce(e.store, m.b.store) AS store,
       round(CASE WHEN e.store IS NOT NULL THEN 1.0::DOUBLE ELSE m.b.similarity END, 9) AS similarity
FROM l LEFT JOIN e ON e.lookup = l.doc_id LEFT JOIN m ON m.lookup = l.doc_id
"""


def invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cached answers over the parts of their lines: parts of size 1 have been modified, and
    answers of some priorities are dropped by the prefix of their key."""
    li = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey").cast("string")).alias("files"))
    key = F.concat_ws(":", "o_orderpriority", F.col("o_orderkey").cast("string"))
    entries = read(spark, sf_dir, "orders").join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(key.alias("key"), F.coalesce("files", F.array().cast("array<string>")).alias("files"), "o_custkey")
    modified = read(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_partkey").cast("string").alias("file"))
    prefixes = spark.createDataFrame([("1-",), ("4-NOT",), ("5-LOW:1",)], "prefix string")
    kept = semantic.without_prefix(semantic.invalidated(entries, modified), prefixes)
    return kept.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.size("files")).alias("files"), F.min("key").alias("first_key"))


INVALIDATION_SQL = """
WITH f AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
hit AS (SELECT DISTINCT l_orderkey FROM f JOIN part ON p_partkey = l_partkey WHERE p_size = 1),
n AS (SELECT l_orderkey, count(*) AS n FROM f GROUP BY 1),
k AS (SELECT o_custkey, o_orderpriority || ':' || o_orderkey AS key, coalesce(n, 0) AS n FROM orders LEFT JOIN n ON n.l_orderkey = o_orderkey WHERE o_orderkey NOT IN (SELECT l_orderkey FROM hit))
SELECT o_custkey, count(*) AS kept, sum(n)::BIGINT AS files, min(key) AS first_key FROM k
WHERE NOT starts_with(key, '1-') AND NOT starts_with(key, '4-NOT') AND NOT starts_with(key, '5-LOW:1') GROUP BY o_custkey
"""

QUERIES = {"semantic_lookup": semantic_lookup, "invalidation": invalidation}
ORACLES = {"semantic_lookup": LOOKUP_SQL, "invalidation": INVALIDATION_SQL}
