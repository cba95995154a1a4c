"""Ranks, running sums and islands that stay distributed.

A window without a partition key would put all rows in one task. ``running`` splits it in two
levels: rows are dealt to buckets of the order (hours of a timestamp, say), bucket totals are summed
over the few buckets, and each row adds the sum inside its bucket to what came before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .relational import small


def running(df: DataFrame, value: Column, order: Sequence[Column], bucket: Column, keys: Sequence[str] = (), name: str = "running") -> DataFrame:
    """Inclusive running sum of ``value`` in ``order``; ``bucket`` must rise with the order."""
    rows = df.withColumn("_b", bucket).withColumn("_v", value)
    totals = rows.groupBy(*keys, "_b").agg(F.sum("_v").alias("_t"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_t").over(W.partitionBy(*keys, F.lit(0)).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    joined = rows.join(small(before.drop("_t")), [*keys, "_b"])
    inside = F.sum("_v").over(W.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return joined.withColumn(name, F.col("_before") + inside).drop("_b", "_v", "_before")


def value_at_rank(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], cells: int = 1000) -> DataFrame:
    """Value at 0-based rank floor(p n) for each key, exactly.

    Counts over ``cells`` cells of the value's range find the cell that holds the rank; only the different
    values of that cell are sorted, with their counts."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / cells
    cell = F.when(width > 0, F.least(F.lit(cells - 1), F.floor((F.col(value) - F.col("_lo")) / width))).otherwise(F.lit(0)).alias("_c")
    rows = df.where(F.col(value).isNotNull()).join(small(ends), list(keys)).select(*keys, F.col(value).alias("_v"), "_n", cell)
    counts = rows.groupBy(*keys, "_c", "_n").agg(F.count(F.lit(1)).alias("_k"))
    below = F.coalesce(F.sum("_k").over(W.partitionBy(*keys).orderBy("_c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wanted = counts.withColumn("_below", below).withColumn("_p", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(p).alias("p")) for k, p in shares.items()])))
    rank = F.least(F.floor(F.col("_p.p") * F.col("_n")), F.col("_n") - 1)
    wanted = wanted.where((rank >= F.col("_below")) & (rank < F.col("_below") + F.col("_k"))).select(*keys, "_c", F.col("_p.name").alias("_name"), (rank - F.col("_below")).alias("_r"))
    # the cell's different values with their counts, so that a common value is one row
    inside = rows.join(small(wanted), [*keys, "_c"]).groupBy(*keys, "_name", "_r", "_v").agg(F.count(F.lit(1)).alias("_m"))
    through = F.sum("_m").over(W.partitionBy(*keys, "_name").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    picked = inside.withColumn("_t", through).where((F.col("_t") > F.col("_r")) & (F.col("_t") - F.col("_m") <= F.col("_r"))).select(*keys, "_name", F.col("_v").alias("_x"))
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == k, F.col("_x"))).alias(k) for k in shares])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each key in ``order`` (Spark limits each partition before the exchange)."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def newest_share(df: DataFrame, order: Sequence[str], bucket: Column, share: float) -> DataFrame:
    """The newest floor(share n) rows of the whole frame."""
    keep = int(df.count() * share)
    ranked = running(df, F.lit(1), [F.col(c).desc() for c in order], -bucket, name="_rank")
    return ranked.where(F.col("_rank") <= keep).drop("_rank")


def last_rows(keys: Sequence[str], order: Sequence[str], rows: int):
    """Window of a row and the ``rows`` - 1 before it."""
    return W.partitionBy(*keys).orderBy(*order).rowsBetween(-(rows - 1), 0)


def moving_average(value: str, keys: Sequence[str], order: Sequence[str], rows: int) -> Column:
    return F.avg(value).over(last_rows(keys, order, rows))


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column) -> DataFrame:
    """Runs of consecutive flagged rows: keys, island, length."""
    w = W.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_f", flag).withColumn("island", F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.where("_f").groupBy(*keys, "island").agg(F.count(F.lit(1)).alias("length"))


def evicted(entries: DataFrame, order: Sequence[str], bucket: Column, size: str, required: int) -> DataFrame:
    """Least recently used entries, oldest first, until ``required`` is freed."""
    run = running(entries, F.col(size), [F.col(c) for c in order], bucket, name="_freed")
    return run.where(F.col("_freed") - F.col(size) < required).drop("_freed")


def share_of_parent(df: DataFrame, keys: Sequence[str], value: str) -> Column:
    """NaN where the parent's total is 0."""
    total = F.sum(value).over(W.partitionBy(*keys))
    return F.when(total == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.col(value), total))
