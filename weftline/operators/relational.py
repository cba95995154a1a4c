"""Joins, set operations and grouped merges with explicit order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import let
from .cluster import stored

COMMON = 100_000  # items whose numbers are broadcast
SPREAD = 240  # tasks of a join whose output outgrows its input, which sizes its tasks otherwise
CARRIED = 64  # items that a set may have to travel with them
BLOCK = 256  # sets of a home that are compared with all that come there in one place
RANKED = 1_000_000  # items of coded sets that are put in order by how common they are; 16 bytes of a task each
WORDS = 16  # of 64 bits in a set's sketch


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Broadcast hint if the frame is counted to hold at most ``rows`` rows; else unchanged, so that
    the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: the last in ``order`` (a hash table in which later entries overwrite)."""
    rest = [c for c in df.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(top).select(*keys, "_row.*")


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def lookup_left(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Left outer join to the last entry of each key."""
    return left.join(last_wins(right, keys, order), list(keys), "left")


def covered(parent: DataFrame, part: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``parent`` that ``part`` has too."""
    return parent.join(part, list(keys), "left_semi")


def uncovered(parent: DataFrame, part: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``parent``, repeats and all, that ``part`` lacks."""
    return parent.join(part, list(keys), "left_anti")


def assigned_twice(part: DataFrame, keys: Sequence[str]) -> DataFrame:
    return part.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def upsert(base: DataFrame, change: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All keys of both; a changed row replaces the base's. Adds ``action``: insert, update or keep."""
    rest = [c for c in base.columns if c not in keys]
    a = base.select(*keys, F.struct(*rest).alias("_a"))
    b = change.select(*keys, F.struct(*rest).alias("_b"))
    both = a.join(b, list(keys), "full")
    action = F.when(F.col("_b").isNull(), "keep").when(F.col("_a").isNull(), "insert").otherwise("update")
    return both.select(*keys, F.coalesce("_b", "_a").alias("_row"), action.alias("action")).select(*keys, "_row.*", "action")


def positional(left: DataFrame, right: DataFrame, keys: Sequence[str], default: Column, value: str) -> DataFrame:
    """Rows zipped by their ordinal within ``keys`` (the last of ``keys``); what has no partner takes the default."""
    return left.join(right, list(keys), "left").withColumn(value, F.coalesce(F.col(value), default))


def first_match(rows: Column, test) -> Column:
    """First element of an array that passes ``test``, else its first element."""
    hit = F.filter(rows, test)
    return F.coalesce(F.get(hit, F.lit(0)), F.get(rows, F.lit(0)))


def theta_pairs(df: DataFrame, ordinal: str, block: Sequence[str] = ()) -> DataFrame:
    """All pairs i < j (columns prefixed a_ and b_); with ``block``, only pairs that agree in it."""
    a = df.select([F.col(c).alias(f"a_{c}") for c in df.columns])
    b = df.select([F.col(c).alias(f"b_{c}") for c in df.columns])
    on = F.col(f"a_{ordinal}") < F.col(f"b_{ordinal}")
    for c in block:
        on = on & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    return a.join(b, on)


def rarest_first(sets: DataFrame, keys: Sequence[str], items: str, context: Sequence[str] = ()) -> DataFrame:
    """keys, context, s: the distinct items of each set in one order for all sets of a context, the rarest first.

    Any such order serves prefix filtering, so only the ``COMMON`` commonest items are ranked by their number (and broadcast); all rarer
    ones come before them. A set is dealt to its task once and its items are put in order there. Null items are left out."""
    each = sets.select(*keys, *context, F.explode(F.array_distinct(items)).alias("i")).where("i is not null")
    top = each.groupBy(*context, "i").agg(F.count(F.lit(1)).alias("f")).where("f > 1").orderBy(F.desc("f"), *context, "i").limit(COMMON)
    dealt = sets.select(*keys, *context, items).repartition(*keys)
    each = dealt.select(*keys, *context, F.explode(F.array_distinct(items)).alias("i")).where("i is not null")
    rows = F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "i")))
    return each.join(F.broadcast(top), [*context, "i"], "left").groupBy(*keys, *context).agg(F.transform(rows, lambda x: x["i"]).alias("s"))


def need(n: Column, m: Column, at_least: float) -> Column:
    """Least number of shared items with which sets of n and m items reach a Jaccard of ``at_least``."""
    return F.ceil(F.lit(at_least / (1 + at_least)) * (n + m) - 1e-6)


def prefix(s: Column, at_least: float) -> Column:
    """Items of a set in order, of which another one that reaches ``at_least`` must have one: the first n - ceil(t n) + 1."""
    return F.slice(s, F.lit(1), F.size(s) - F.ceil(F.lit(at_least) * F.size(s) - 1e-9).cast("int") + 1)


def index_prefix(s: Column, n: Column, at_least: float) -> Column:
    """Items of the smaller set of a pair, of which the larger one's prefix must have one: the first n - ceil(2 t / (1 + t) n) + 1."""
    return F.slice(s, F.lit(1), n - F.ceil(F.lit(2 * at_least / (1 + at_least)) * n - 1e-9).cast("int") + 1)


def entries(ranked: DataFrame, keys: Sequence[str], at_least: float, side: str, indexed: bool = False) -> DataFrame:
    """One row for each item i of a set's prefix (that of a pair's smaller set where ``indexed``): keys, its size n and what is left of the set
    behind the item, both marked by ``side``."""
    n = F.size("s")
    first = index_prefix(F.col("s"), n, at_least) if indexed else prefix(F.col("s"), at_least)
    rows = ranked.select(*keys, n.alias(f"n_{side}"), F.posexplode(first).alias("_p", "i"))
    return rows.withColumn(f"rest_{side}", F.col(f"n_{side}") - F.col("_p") - 1).drop("_p")


def may_reach(at_least: float, a: str, b: str) -> Column:
    """Whether two sets that meet at an item of their prefixes may reach the threshold if it is the first they share."""
    n, m = F.col(f"n_{a}"), F.col(f"n_{b}")
    close = F.least(n, m) >= F.lit(at_least) * F.greatest(n, m) - 1e-9
    return close & (1 + F.least(f"rest_{a}", f"rest_{b}") >= need(n, m, at_least))


def overlap_pairs(sets: DataFrame, key: str, items: str, at_least: float, ranked: bool = False) -> DataFrame:
    """Pairs of sets with Jaccard >= ``at_least`` by prefix filtering.

    Items are ordered rarest first (``ranked``: they come so, without nulls or repeats); two sets that reach the threshold share an item among
    the first n - ceil(t n) + 1 of each, so only those are joined, and sizes and the items behind must allow the threshold. Small sets
    travel with their items and are compared where they meet, at the first item they share; of larger ones only
    the keys travel until it is known who may be like whom. Exact; keys come out as a < b with the similarity."""
    own = stored(sets.select(key, F.col(items).alias("s")).where(F.size("s") > 0) if ranked else rarest_first(sets, [key], items))
    longest = own.agg(F.max(F.size("s"))).first()[0] or 0
    if longest > CARRIED:
        return _compared(own.withColumnRenamed(key, "k"), at_least)
    entry = {x: entries(own.withColumnRenamed(key, x), [x, "s"], at_least, x).withColumnsRenamed({"s": f"s_{x}"}) for x in "ab"}
    met = entry["a"].repartition(SPREAD, "i").join(entry["b"].repartition(SPREAD, "i"), "i").where((F.col("a") < F.col("b")) & may_reach(at_least, "a", "b"))
    both = met.where(F.get(F.array_intersect("s_a", "s_b"), F.lit(0)) == F.col("i"))
    return both.select("a", "b", shared_share(F.col("s_a"), F.col("s_b")).alias("similarity")).where(F.col("similarity") >= at_least)


def _compared(ranked: DataFrame, at_least: float) -> DataFrame:
    """``overlap_pairs`` of sets (k, s) too large to travel to each item or with each pair."""
    entry = {x: entries(ranked.withColumnRenamed("k", x), [x], at_least, x, x == "b") for x in "ab"}
    less = (F.col("n_b") < F.col("n_a")) | ((F.col("n_b") == F.col("n_a")) & (F.col("b") < F.col("a")))
    met = entry["a"].repartition(SPREAD, "i").join(entry["b"].repartition(SPREAD, "i"), "i").where(less & may_reach(at_least, "a", "b"))
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    drawn = ranked.mapInArrow(_sketched, "k long, n int, " + ", ".join(f"w{i} long" for i in range(WORDS)))
    n, m = F.col("n_a"), F.col("n_b")
    differ = sum((F.bit_count(F.col(f"w{i}_a").bitwiseXOR(F.col(f"w{i}_b"))) for i in range(WORDS)), F.lit(0))
    close = (F.least(n, m) >= F.lit(at_least) * F.greatest(n, m) - 1e-9) & (differ <= n + m - 2 * need(n, m, at_least))
    likely = _at_homes(pairs, drawn).where(close).select("a", "b")
    n, m, k = F.size("s_a"), F.size("s_b"), F.size(F.array_intersect("s_a", "s_b"))
    both = _at_homes(likely, ranked).where((F.least(n, m) >= F.lit(at_least) * F.greatest(n, m) - 1e-9) & (k >= need(n, m, at_least)))
    return both.select("a", "b", (k / (n + m - k)).alias("similarity")).where(F.col("similarity") >= at_least)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item turns over one bit of its set's sketch, so two sets differ in at least as many items as their sketches in bits."""
    for batch in batches:
        s = batch.column("s")
        size = s.value_lengths().to_numpy()
        codes = s.flatten().cast(pa.int64()).to_numpy()
        bit = (codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)
        words = np.zeros(len(size) * WORDS, np.uint64)
        np.bitwise_xor.at(words, np.repeat(np.arange(len(size)) * WORDS, size) + (bit % np.uint64(WORDS)).astype(np.int64), np.uint64(1) << (bit >> np.uint64(4)))
        words = words.view(np.int64).reshape(-1, WORDS)
        yield pa.record_batch([batch.column("k"), pa.array(size, pa.int32()), *[pa.array(words[:, i]) for i in range(WORDS)]], names=["k", "n", *[f"w{i}" for i in range(WORDS)]])


def _at_homes(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (k, ...) of all pairs a < b that meet where ``pairs`` do, these among them, each once; columns are marked _a and _b but for a and b."""
    own = {}
    for x, met in zip("ab", homes(stored(pairs)), strict=True):
        marked = small(met, 1_000_000).join(rows, "k").withColumnsRenamed({"k": x} | {c: f"{c}_{x}" for c in rows.columns if c != "k"})
        own[x] = marked.repartition(SPREAD, "home", "part")
    return own["a"].join(own["b"], ["home", "part"]).where("a < b")


def homes(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(home, part, k) of the smaller and of the larger keys of pairs (a, b): where the sets behind them meet.

    A key's home is the least key it is paired with. Each smaller key goes to its home once, each larger one to the homes of those it is paired
    with, which among near copies is one place; so what travels grows with the sets and not with their pairs. Of a home's smaller keys about
    ``BLOCK`` form a part, and larger ones go to each part."""
    least = pairs.groupBy("b").agg(F.min("a").alias("home")).withColumnRenamed("b", "a")
    placed = stored(pairs.join(least, "a", "left").withColumn("home", F.coalesce("home", "a")))
    left = placed.select("home", F.col("a").alias("k")).distinct()
    parts = left.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    left = left.join(parts, "home").select("home", F.pmod(F.xxhash64("k"), "parts").cast("int").alias("part"), "k")
    right = placed.select("home", F.col("b").alias("k")).distinct().join(parts, "home")
    return stored(left), stored(right.select("home", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "k"))


def coded(sets: DataFrame, key: str, items: str, context: Sequence[str] = ()) -> DataFrame:
    """key and s: the ``items`` (strings, distinct, none null) of each set as numbers, rarest first, without a shuffle of the sets; those of
    different contexts differ.

    The ``RANKED`` commonest at most are numbered by how common they are, all others are negative hashes; the first seed is taken by which different items
    have different hashes, so equal numbers are equal items."""
    for seed in range(100):
        rare = lambda x: F.xxhash64(F.lit(seed), *context, x).bitwiseOR(F.lit(-(1 << 63)))  # noqa: B023, E731
        each = sets.select(*context, F.explode(items).alias("i")).select(rare(F.col("i")).alias("h"), F.xxhash64(F.lit(-1), *context, "i").alias("other"))
        count = stored(each.groupBy("h").agg(F.count(F.lit(1)).alias("f"), F.min("other").alias("x"), F.max("other").alias("y")))
        if count.where("x <> y").isEmpty():
            break
    else:
        raise ValueError("no seed tells all items apart")
    least, held = 1 << 62, 0
    for f, n in sorted(((r["f"], r["n"]) for r in count.where("f > 1").groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):
        held += n
        if held > RANKED:
            break
        least = f
    top = count.where(F.col("f") >= least).select("h", "f").toArrow()
    h, f = (top.column(c).to_numpy() for c in ("h", "f"))
    number = np.empty(len(h), np.int64)
    number[np.lexsort((h, f))] = np.arange(len(h))
    order = np.argsort(h)
    shared = sets.sparkSession.sparkContext.broadcast((h[order], number[order]))
    rows = sets.select(key, F.transform(items, rare).alias("s"))
    return rows.mapInArrow(_numbered(shared, key), rows.schema)


def _numbered(shared, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, numbers = shared.value
        for batch in batches:
            s = batch.column("s")
            size = s.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            codes = s.flatten().to_numpy(zero_copy_only=False)
            if len(known):
                at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
                codes = np.where(known[at] == codes, numbers[at], codes)
            own = np.repeat(np.arange(len(size)), size)
            codes = codes[np.lexsort((codes, own))]
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            yield pa.record_batch([batch.column(key), pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes, pa.int64()))], names=[key, "s"])

    return run


def shared_share(x: Column, y: Column) -> Column:
    """Jaccard of two arrays of distinct items."""
    return let(F.size(F.array_intersect(x, y)), lambda k: k / (F.size(x) + F.size(y) - k))


def ordered_text(value: str, order: Sequence[str], separator: str) -> Column:
    """Aggregate: texts joined in ``order``."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return F.array_join(F.transform(rows, lambda r: r["_v"]), separator)


def ordered_distinct(value: str, order: Sequence[str]) -> Column:
    """Aggregate: distinct values, first seen first."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return F.array_distinct(F.transform(rows, lambda r: r["_v"]))


def merge_files(files: DataFrame, key: str, order: str, patch: str) -> DataFrame:
    """One row a file: the first row's columns, all patches joined by a newline."""
    rest = [c for c in files.columns if c not in (key, patch)]
    first = F.min_by(F.struct(*rest), F.col(order)).alias("_row")
    return files.groupBy(key).agg(first, ordered_text(patch, [order], "\n").alias(patch)).select(key, "_row.*", patch)


def batches(ordinal: Column, size: Column) -> Column:
    """Number of the fixed-size batch of a 0-based ordinal."""
    return F.floor(ordinal / size).cast("long")


def pair_batch_size(n: Column) -> Column:
    """Step function of the number of pairs."""
    return F.when(n <= 10, F.greatest(F.lit(1), F.ceil(n / 3))).when(n <= 30, F.greatest(F.lit(3), F.ceil(n / 8))).when(n <= 100, F.greatest(F.lit(5), F.ceil(n / 10))).when(n <= 200, F.greatest(F.lit(10), F.ceil(n / 10))).otherwise(F.greatest(F.lit(15), F.ceil(n / 10))).cast("long")


def domain_batch_size(n: Column) -> Column:
    return F.when(n <= 5, F.greatest(F.lit(1), F.ceil(n / 3))).when(n <= 20, F.greatest(F.lit(2), F.ceil(n / 8))).when(n <= 50, F.greatest(F.lit(5), F.ceil(n / 10))).otherwise(F.greatest(F.lit(8), F.ceil(n / 10))).cast("long")
