"""Lookup of earlier answers by exact key or by likeness of meaning, as of a time, and their invalidation.

``stores`` (context, key, at, ttl, tokens, seq) is the log of answers put by: an answer lives from ``at`` through ``at + ttl``,
or until the same key is stored again, which keeps the place it had in the order if it was still alive. ``lookups`` (lookup, context, key, at, tokens)
ask at a time. The answer is that of the exact key, else of the first placed answer alive whose
tokens have a Jaccard of at least ``likeness`` with those asked for.

Time is cut into buckets as long as the longest life, so that each lookup meets the answers of its own time and not the
history. Tokens are compared once for each pair of different token sets of a context that meet in a bucket, found by prefix
filtering (two sets that reach the threshold share one of their rarest tokens)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cluster import stored
from .relational import entries, may_reach, rarest_first, shared_share, small


def versions(stores: DataFrame) -> DataFrame:
    """Each stored answer with ``until`` (last time it answers) and ``place`` (seq at which its key came in, alive since)."""
    w = W.partitionBy("context", "key").orderBy("at", "seq")
    ends = F.col("at") + F.col("ttl")
    rows = stores.withColumn("until", F.least(ends, F.lead("at").over(w) - 1)).withColumn("_new", (F.coalesce(F.lag(ends).over(w), F.lit(-1)) < F.col("at")).cast("int"))
    rows = rows.withColumn("_chain", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.withColumn("place", F.min("seq").over(W.partitionBy("context", "key", "_chain"))).drop("_new", "_chain")


def similar_sets(left: DataFrame, right: DataFrame, block: str, at_least: float) -> DataFrame:
    """(block, l, r, similarity) of all distinct token sets of the two sides with Jaccard >= ``at_least``.

    Both have ``block`` and ``tokens`` (sorted, distinct; no empty sets match)."""
    sides = [df.select(block, "tokens", mark(F.col(block), F.col("tokens")).alias("set")) for df in (left, right)]
    sets = ranked_sets(sides[0].unionByName(sides[1]), block, "set")
    pairs = similar(sets, *(df.select("set", F.lit(0).alias("_b")).distinct() for df in sides), block, at_least)
    named = sides[0].unionByName(sides[1]).groupBy("set").agg(F.first(block).alias(block), F.first("tokens").alias("tokens"))
    out = pairs.join(named.select(F.col("set").alias("l"), block, F.col("tokens").alias("tl")), "l").join(named.select(F.col("set").alias("r"), F.col("tokens").alias("tr")), "r")
    return out.select(block, F.col("tl").alias("l"), F.col("tr").alias("r"), "similarity")


def mark(context: Column, tokens: Column) -> Column:
    """Name of a token set in its context, of 128 bits: it travels instead of the tokens."""
    return F.unhex(F.md5(F.to_json(F.struct(context.alias("c"), tokens.alias("t")))))


def ranked_sets(sets: DataFrame, context: str, name: str) -> DataFrame:
    """name, context and s (the tokens, rarest first) of each set that has tokens."""
    return stored(rarest_first(sets.where(F.size("tokens") > 0).dropDuplicates([name]), [name], "tokens", [context]))


def similar(sets: DataFrame, left: DataFrame, right: DataFrame, context: str, at_least: float) -> DataFrame:
    """(l, r, similarity) of the sets of the two sides (set, _b) that meet in a context and a bucket and have Jaccard >= ``at_least``.

    Exact: prefix filtering with the rarest first, then sizes and the tokens behind, then the sets themselves. Only names travel until then, and
    what is similar is worked out once for each pair of sets, in however many buckets they meet."""
    entry = {x: df.join(entries(sets, ["set", context], at_least, x), "set").withColumnRenamed("set", x) for x, df in (("l", left), ("r", right))}
    pairs = entry["l"].join(entry["r"], [context, "_b", "i"]).where(may_reach(at_least, "l", "r")).select("l", "r").distinct()
    both = pairs.join(sets.select(F.col("set").alias("l"), F.col("s").alias("s_l")), "l").join(sets.select(F.col("set").alias("r"), F.col("s").alias("s_r")), "r")
    return both.select("l", "r", shared_share(F.col("s_l"), F.col("s_r")).alias("similarity")).where(F.col("similarity") >= at_least)


def _bucket(at: Column, life: int) -> Column:
    return F.floor(at / max(1, life))


def _held(answers: DataFrame, life: int) -> DataFrame:
    """Each answer in the buckets of time in which it is alive: two at most."""
    return answers.withColumn("_b", F.explode(F.sequence(_bucket(F.col("at"), life), _bucket(F.greatest("at", "until"), life))))


def _answered(asked: DataFrame, answers: DataFrame, keys: list[str], life: int, best: Column) -> DataFrame:
    """lookup and its best answer among those alive, met by ``keys`` and a bucket of time."""
    held = _held(answers, life).withColumnsRenamed({"at": "stored_at", "seq": "stored_seq"})
    both = asked.withColumn("_b", _bucket(F.col("at"), life)).join(held, [*keys, "_b"])
    return both.where((F.col("stored_at") <= F.col("at")) & (F.col("at") <= F.col("until"))).groupBy("lookup").agg(best.alias("best"))


def found(lookups: DataFrame, stores: DataFrame, likeness: float = 0.85) -> DataFrame:
    """lookup, kind (exact, semantic, miss), store (seq of the answer; null for a miss) and similarity."""
    tokens = F.array_sort(F.array_distinct("tokens"))
    named = [df.withColumn("tokens", tokens).withColumn("set", mark(F.col("context"), F.col("tokens"))) for df in (lookups, stores)]
    sets = ranked_sets(named[0].select("context", "tokens", "set").unionByName(named[1].select("context", "tokens", "set")), "context", "set")
    asked = stored(named[0].select("lookup", "context", "key", "at", "set"))
    answers = stored(versions(named[1].select("context", "key", "at", "ttl", "seq", "set")).where("until >= at"))
    life = answers.agg(F.max(F.col("until") - F.col("at") + 1)).first()[0] or 1
    exact = _answered(asked.drop("set"), answers.drop("set"), ["context", "key"], life, F.struct(F.max("stored_seq").alias("store")))
    near = stored(asked.join(exact, "lookup", "left_anti").select("lookup", "context", "at", "set"))
    pairs = similar(sets, near.select("set", _bucket(F.col("at"), life).alias("_b")).distinct(), _held(answers, life).select("set", "_b").distinct(), "context", likeness)
    near = near.join(pairs.withColumnsRenamed({"l": "set", "r": "other"}), "set").select("lookup", "at", F.col("other").alias("set"), "similarity")
    first = F.min_by(F.struct(F.col("stored_seq").alias("store"), "similarity"), F.struct("place", "stored_seq"))
    semantic = _answered(near, answers.drop("key", "context"), ["set"], life, first)
    hits = exact.select("lookup", F.lit("exact").alias("kind"), F.col("best.store").alias("store"), F.lit(1.0).alias("similarity"))
    hits = hits.unionByName(semantic.select("lookup", F.lit("semantic").alias("kind"), "best.store", "best.similarity"))
    return asked.select("lookup").join(hits, "lookup", "left").withColumn("kind", F.coalesce("kind", F.lit("miss")))


def invalidated(entries: DataFrame, modified: DataFrame) -> DataFrame:
    """Rows of ``entries`` (key, files, ...) that hold none of the ``modified`` files (file).

    The index is inverted: entries meet the files one by one, and what meets is taken out by key, so that no
    entry is compared with the whole list."""
    hit = entries.select("key", F.explode("files").alias("file")).join(small(modified.select("file").distinct()), "file", "left_semi").select("key").distinct()
    return entries.join(hit, "key", "left_anti")


def without_prefix(entries: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Rows whose key begins with none of the ``prefixes`` (prefix): one equality join for each length that occurs."""
    lengths = [r["n"] for r in prefixes.select(F.length("prefix").alias("n")).where("n is not null").distinct().collect()]  # as many as lengths differ
    cuts = F.array(*[F.when(F.length("key") >= n, F.left("key", F.lit(n))) for n in sorted(lengths)]) if lengths else F.array().cast("array<string>")
    hit = entries.select("key", F.explode(F.array_compact(cuts)).alias("prefix")).join(small(prefixes.select("prefix").distinct()), "prefix", "left_semi").select("key").distinct()
    return entries.join(hit, "key", "left_anti")
