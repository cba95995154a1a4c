"""Join, set, pair and clustering queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..operators import cluster, ordered, relational as rel
from ..operators.cluster import stored
from .tables import read


def name_similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of part names, both ways, for pairs of distinct names that share a word, with the
    number of parts behind each; equal names are one class, named by its least key."""
    names = read(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("rep"), F.count(F.lit(1)).alias("parts"))
    word = names.select("rep", F.explode(F.array_distinct(sim.tokens(F.col("p_name")))).alias("w"))
    pairs = word.withColumnRenamed("rep", "a").join(word.withColumnRenamed("rep", "b"), "w").where("a < b").select("a", "b").distinct()
    left, right = (names.select(F.col("rep").alias(k), F.col("p_name").alias(f"n{k}"), F.col("parts").alias(f"parts_{k}")) for k in "ab")
    both = pairs.join(left, "a").join(right, "b")
    return both.select("a", "b", "parts_a", "parts_b", F.round(sim.word_similarity(F.col("na"), F.col("nb")), 6).alias("forward"), F.round(sim.word_similarity(F.col("nb"), F.col("na")), 6).alias("backward"))


NAME_SQL = r"""
WITH n AS (SELECT p_name, min(p_partkey) AS rep, count(*) AS parts, string_split_regex(lower(p_name), '\s+') AS w FROM part GROUP BY p_name)
SELECT x.rep AS a, y.rep AS b, x.parts AS parts_a, y.parts AS parts_b,
  round(len(list_filter(x.w, lambda t: list_contains(y.w, t))) / len(list_distinct(list_concat(x.w, y.w))), 6) AS forward,
  round(len(list_filter(y.w, lambda t: list_contains(x.w, t))) / len(list_distinct(list_concat(x.w, y.w))), 6) AS backward
FROM n x JOIN n y ON x.rep < y.rep WHERE list_has_any(x.w, y.w)
"""


def set_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of orders whose part sets have Jaccard of at least 0.3 (prefix-filtered join)."""
    sets = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    return rel.overlap_pairs(sets, "l_orderkey", "parts", 0.3).select("a", "b", F.round("similarity", 6).alias("similarity"))


OVERLAP_SQL = """
WITH i AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), n AS (SELECT o, count(*) AS n FROM i GROUP BY o),
c AS (SELECT x.o AS a, y.o AS b, count(*) AS k FROM i x JOIN i y ON x.p = y.p AND x.o < y.o GROUP BY ALL)
SELECT a, b, round(k / (na.n + nb.n - k), 6) AS similarity FROM c JOIN n na ON na.o = a JOIN n nb ON nb.o = b WHERE k / (na.n + nb.n - k) >= 0.3::DOUBLE
"""


def semantic_key_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents of one language whose semantic keys have Jaccard of at least 0.85; documents
    with one key are a class, named by its least identifier, with its size."""
    docs = read(spark, sf_dir, "documents").where("lang is not null")
    words = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "lang", sim.semantic_set(F.coalesce("text", F.lit(""))).alias("k"))
    keys = stored(words.withColumn("name", F.unhex(F.md5(F.array_join("k", " ")))))
    named = keys.groupBy("lang", "name").agg(F.min(F.struct("doc_id", "row")).alias("rep"), F.count(F.lit(1)).alias("members"))
    named = stored(named.select("rep.row", F.col("rep.doc_id").alias("rep"), "members"))
    first = keys.select("row", "lang", "k").join(rel.small(named.select("row"), 1_000_000), "row", "left_semi")
    found = rel.overlap_pairs(rel.coded(first, "row", "k", ["lang"]), "row", "s", 0.85, ranked=True)
    size = {x: rel.small(named, 1_000_000).select(F.col("row").alias(x), F.struct("rep", "members").alias(f"of_{x}")) for x in "ab"}
    out = found.join(size["a"], "a").join(size["b"], "b").select(F.inline(F.array(F.struct(F.least("of_a", "of_b").alias("x"), F.greatest("of_a", "of_b").alias("y"), "similarity")))).where("x.rep < y.rep")
    return out.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.col("x.members").alias("members_a"), F.col("y.members").alias("members_b"), F.round("similarity", 6).alias("similarity"))


SEMANTIC_SQL = rf"""
WITH t AS (SELECT doc_id, lang, list_sort(list_distinct(list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^\w\s]', ' ', 'g'), '\s+'),
             lambda w: length(w) > 2 AND NOT list_contains([{", ".join(repr(w) for w in sim.STOP_WORDS)}], w)))) AS k FROM documents),
r AS (SELECT lang, k, min(doc_id) AS rep, count(*) AS members FROM t GROUP BY lang, k),
p AS (SELECT x.rep AS a, y.rep AS b, x.members AS members_a, y.members AS members_b, len(list_intersect(x.k, y.k)) AS i, len(x.k) AS na, len(y.k) AS nb
  FROM r x JOIN r y ON x.lang = y.lang AND x.rep < y.rep AND len(x.k) >= 0.85 * len(y.k) AND len(y.k) >= 0.85 * len(x.k))
SELECT a, b, members_a, members_b, round(i / (na + nb - i), 6) AS similarity FROM p WHERE na + nb - i > 0 AND i / (na + nb - i) >= 0.85::DOUBLE
"""


def context_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap coefficient of benchmark items that share a word."""
    items = read(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.filter(sim.tokens("text"), lambda w: w != "")).alias("w"))
    n = items.select("item_id", F.size("w").alias("n"))
    word = items.select("item_id", F.explode("w").alias("w"))
    common = word.withColumnRenamed("item_id", "a").join(word.withColumnRenamed("item_id", "b"), "w").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"))
    out = common.join(n.select(F.col("item_id").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("item_id").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", F.round(F.col("k") / F.least("na", "nb"), 6).alias("overlap"))


CONTEXT_SQL = r"""
WITH i AS (SELECT DISTINCT item_id, unnest(string_split_regex(lower(text), '\s+')) AS w FROM benchmark), j AS (SELECT * FROM i WHERE w <> ''), n AS (SELECT item_id, count(*) AS n FROM j GROUP BY ALL),
c AS (SELECT x.item_id AS a, y.item_id AS b, count(*) AS k FROM j x JOIN j y ON x.w = y.w AND x.item_id < y.item_id GROUP BY ALL)
SELECT a, b, round(k / least(na.n, nb.n), 6) AS overlap FROM c JOIN n na ON na.item_id = a JOIN n nb ON nb.item_id = b
"""


def leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy leader clusters of distinct part names (in key order) at word Jaccard 0.5; every part gets its name's leader."""
    parts = read(spark, sf_dir, "part")
    names = parts.groupBy("p_name").agg(F.min("p_partkey").alias("rep"))
    edges = rel.overlap_pairs(names.withColumn("w", sim.tokens(F.col("p_name"))), "rep", "w", 0.5).select("a", "b")
    found = cluster.leaders(names, edges, "rep")
    return parts.join(names, "p_name").join(found.withColumnRenamed("item", "rep"), "rep").select("p_partkey", "leader")


LEADER_SQL = """
WITH RECURSIVE n AS (SELECT min(p_partkey) AS rep, p_name, list_distinct(string_split_regex(lower(p_name), '\\s+')) AS w, row_number() OVER (ORDER BY min(p_partkey)) AS i FROM part GROUP BY p_name),
near AS (SELECT x.i, x.rep, coalesce(list(y.rep) FILTER (y.rep IS NOT NULL), []) AS l FROM n x LEFT JOIN n y ON y.rep > x.rep AND len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))) >= 0.5::DOUBLE GROUP BY ALL),
g AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS leader, []::BIGINT[] AS won, []::BIGINT[] AS gone
  UNION ALL SELECT near.i, CASE WHEN list_contains(gone, rep) THEN NULL ELSE rep END, CASE WHEN list_contains(gone, rep) THEN [] ELSE list_filter(l, lambda x: NOT list_contains(gone, x)) END,
    CASE WHEN list_contains(gone, rep) THEN gone ELSE list_concat(gone, list_append(l, rep)) END FROM g JOIN near ON near.i = g.i + 1),
m AS (SELECT leader AS rep, leader FROM g WHERE leader IS NOT NULL UNION ALL SELECT unnest(won), leader FROM g WHERE leader IS NOT NULL)
SELECT p_partkey, leader FROM part JOIN n USING (p_name) JOIN m USING (rep)
"""


def first_match_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First word of a part's name that its type contains (else its first word)."""
    words = F.split("p_name", " ")
    hit = rel.first_match(words, lambda w: F.contains(F.lower("p_type"), F.lower(w)))
    return read(spark, sf_dir, "part").select("p_partkey", hit.alias("location"))


LOCATION_SQL = """
SELECT p_partkey, coalesce(list_filter(string_split(p_name, ' '), lambda w: contains(lower(p_type), lower(w)))[1], string_split(p_name, ' ')[1]) AS location FROM part
"""


def semi_anti_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that labels cover and those they do not, by language."""
    docs, part = read(spark, sf_dir, "documents").select("doc_id", "lang"), read(spark, sf_dir, "labels").select("doc_id")
    yes = rel.covered(docs, part, ["doc_id"]).withColumn("side", F.lit("covered"))
    no = rel.uncovered(docs, part, ["doc_id"]).withColumn("side", F.lit("uncovered"))
    return yes.unionByName(no).groupBy("lang", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


COVERAGE_SQL = """
SELECT lang, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'covered' ELSE 'uncovered' END AS side, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY ALL
"""


def left_lookup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return rel.lookup_left(orders, items, ["o_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])


LOOKUP_SQL = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS k FROM lineitem)
SELECT o_orderkey, o_custkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM orders LEFT JOIN r ON l_orderkey = o_orderkey AND k = 1
"""


def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The i-th user turn of a conversation beside its i-th assistant turn."""
    turns = read(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    turns = turns.withColumn("i", F.row_number().over(W.partitionBy("conv_id", "role").orderBy("turn")))
    user = turns.where("role = 'user'").select("conv_id", "i", F.length("text").alias("asked"))
    answer = turns.where("role = 'assistant'").select("conv_id", "i", F.length("text").cast("string").alias("answered"))
    return rel.positional(user, answer, ["conv_id", "i"], F.lit("System Enhancement"), "answered").select("conv_id", F.col("i").cast("long").alias("i"), F.col("asked").cast("long").alias("asked"), "answered")


ZIP_SQL = """
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS i FROM conversations WHERE role IN ('user', 'assistant'))
SELECT u.conv_id, u.i, length(u.text) AS asked, coalesce(CAST(length(a.text) AS VARCHAR), 'System Enhancement') AS answered
FROM t u LEFT JOIN t a ON a.conv_id = u.conv_id AND a.i = u.i AND a.role = 'assistant' WHERE u.role = 'user'
"""


def fold_group_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = read(spark, sf_dir, "conversations")
    agg = conv.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), rel.ordered_text("text", ["turn"], "\n").alias("_t"), F.array_join(rel.ordered_distinct("role", ["turn"]), ",").alias("roles"))
    return agg.select("conv_id", "turns", "roles", F.sha2("_t", 256).alias("text_sha256"))


MERGE_SQL = """
WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY ALL), r AS (SELECT conv_id, string_agg(role, ',' ORDER BY t) AS roles FROM f GROUP BY conv_id)
SELECT c.conv_id, count(*) AS turns, any_value(roles) AS roles, sha256(string_agg(text, chr(10) ORDER BY turn)) AS text_sha256 FROM conversations c JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id
"""


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns update or add to the user turns, keyed by conversation and question number."""
    turns = read(spark, sf_dir, "conversations").withColumn("q", F.floor(F.col("turn") / 2))
    one = lambda role: rel.last_wins(turns.where(F.col("role") == role).select("conv_id", "q", "turn", F.length("text").alias("size")), ["conv_id", "q"], ["turn", "size"])
    return rel.upsert(one("user"), one("assistant"), ["conv_id", "q"]).select("conv_id", "q", "turn", F.col("size").cast("long").alias("size"), "action")


UPSERT_SQL = """
WITH t AS (SELECT conv_id, turn // 2 AS q, turn, role, length(text) AS size FROM conversations),
u AS (SELECT conv_id, q, max(turn) AS turn, arg_max(size, {'a': turn, 'b': size}) AS size FROM t WHERE role = 'user' GROUP BY ALL),
a AS (SELECT conv_id, q, max(turn) AS turn, arg_max(size, {'a': turn, 'b': size}) AS size FROM t WHERE role = 'assistant' GROUP BY ALL)
SELECT coalesce(a.conv_id, u.conv_id) AS conv_id, coalesce(a.q, u.q) AS q, coalesce(a.turn, u.turn) AS turn, coalesce(a.size, u.size) AS size,
  CASE WHEN a.conv_id IS NULL THEN 'keep' WHEN u.conv_id IS NULL THEN 'insert' ELSE 'update' END AS action
FROM u FULL JOIN a ON a.conv_id = u.conv_id AND a.q = u.q
"""


def union_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three kinds of events in turn; per user the first wins and all identifiers are joined in order."""
    ev = read(spark, sf_dir, "events")
    kinds = [ev.where(F.col("event_type") == k).select("user_id", F.lit(i).alias("source"), "event_id", F.col("event_id").cast("string").alias("id_text")) for i, k in enumerate(("click", "view", "error"))]
    every = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    merged = every.groupBy("user_id").agg(F.min_by("event_id", F.struct("source", "event_id")).alias("first_event"), rel.ordered_text("id_text", ["source", "event_id"], "\n").alias("_t"), F.count(F.lit(1)).alias("n"))
    return merged.select("user_id", "first_event", "n", F.sha2("_t", 256).alias("ids_sha256"))


UNION_SQL = """
WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS s FROM events WHERE event_type IN ('click', 'view', 'error'))
SELECT user_id, arg_min(event_id, {'a': s, 'b': event_id}) AS first_event, count(*) AS n, sha256(string_agg(CAST(event_id AS VARCHAR), chr(10) ORDER BY s, event_id)) AS ids_sha256 FROM e GROUP BY user_id
"""


def order_insensitive_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    pairs = rel.theta_pairs(n, "n_nationkey", ["n_regionkey"])
    key = F.concat_ws("-", F.least("a_n_name", "b_n_name"), F.greatest("a_n_name", "b_n_name"))
    return pairs.select("a_n_nationkey", "b_n_nationkey", key.alias("pair"), F.substring(F.sha2(key, 256), 1, 16).alias("cache_key"))


KEY_SQL = """
SELECT a.n_nationkey AS a_n_nationkey, b.n_nationkey AS b_n_nationkey, least(a.n_name, b.n_name) || '-' || greatest(a.n_name, b.n_name) AS pair,
  sha256(least(a.n_name, b.n_name) || '-' || greatest(a.n_name, b.n_name))[1:16] AS cache_key FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey
"""


def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation dealt to batches of the size that the nation's number of pairs asks for."""
    s = read(spark, sf_dir, "supplier").withColumn("i", F.row_number().over(W.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("s_nationkey")))
    size = rel.pair_batch_size(F.col("n") * (F.col("n") - 1) / 2)
    return s.select("s_suppkey", "s_nationkey", size.alias("batch_size"), rel.batches(F.col("i"), size).alias("batch"))


BATCH_SQL = """
WITH s AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i, count(*) OVER (PARTITION BY s_nationkey) AS c FROM supplier),
p AS (SELECT *, c * (c - 1) / 2 AS n FROM s),
z AS (SELECT *, (CASE WHEN n <= 10 THEN greatest(1, ceil(n / 3)) WHEN n <= 30 THEN greatest(3, ceil(n / 8)) WHEN n <= 100 THEN greatest(5, ceil(n / 10)) WHEN n <= 200 THEN greatest(10, ceil(n / 10)) ELSE greatest(15, ceil(n / 10)) END)::BIGINT AS b FROM p)
SELECT s_suppkey, s_nationkey, b AS batch_size, (i // b)::BIGINT AS batch FROM z
"""


def crossref_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to part links, repeats merged to the first, the ten most specific of each supplier."""
    li = read(spark, sf_dir, "lineitem")
    weight = F.when(F.col("l_returnflag") == "R", 5).when(F.col("l_returnflag") == "A", 3).otherwise(1)
    links = li.groupBy("l_suppkey", "l_partkey").agg(F.max(weight).alias("weight"), F.min("l_orderkey").alias("first"))
    top = ordered.top_k(links, ["l_suppkey"], [F.desc("weight"), F.col("first"), F.col("l_partkey")], 10)
    return top.select("l_suppkey", "l_partkey", "weight", F.col("rank").cast("long").alias("rank"))


CROSSREF_SQL = """
WITH l AS (SELECT l_suppkey, l_partkey, max(CASE l_returnflag WHEN 'R' THEN 5 WHEN 'A' THEN 3 ELSE 1 END) AS weight, min(l_orderkey) AS f FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY weight DESC, f, l_partkey) AS rank FROM l)
SELECT l_suppkey, l_partkey, weight, rank FROM r WHERE rank <= 10
"""

QUERIES = {
    f.__name__: f
    for f in (
        name_similarity_pairs, set_overlap_pairs, semantic_key_jaccard, context_overlap, first_match_location, semi_anti_coverage, left_lookup_last_wins, positional_zip,
        fold_group_merge, upsert_latest, union_dedupe, order_insensitive_key, batch_assign, crossref_topk, leader_clusters,
    )
}
ORACLES = dict(zip(QUERIES, (NAME_SQL, OVERLAP_SQL, SEMANTIC_SQL, CONTEXT_SQL, LOCATION_SQL, COVERAGE_SQL, LOOKUP_SQL, ZIP_SQL, MERGE_SQL, UPSERT_SQL, UNION_SQL, KEY_SQL, BATCH_SQL, CROSSREF_SQL, LEADER_SQL), strict=True))
