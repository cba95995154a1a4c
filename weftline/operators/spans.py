"""Nested spans from start and stop events.

Events of one thread work on a stack: a start opens a span inside the one opened last, a stop ends the span opened
last whatever it is called, and a stop with nothing open does nothing. The depth is thus a running sum that cannot fall
below zero (the sum less its least value so far), and at every depth starts and stops take turns, so stops are
found by looking one row ahead and parents by looking back. Windows run over sorted rows and
keep no thread in memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cluster import cut


def nested(events: DataFrame, thread: str = "thread", order: tuple[str, ...] = ("at", "seq")) -> DataFrame:
    """thread, seq, name, at, depth, parent (seq), status, duration of every span.

    events: thread, seq (unique in a thread), at, name, opens (true for a start). Status: closed; mismatched, where
    another name was stopped, which leaves the span without a duration; open, without a stop. The outermost spans have
    depth 1 and no parent. Rows without ``opens`` are ignored, null names match each other."""
    whole = W.partitionBy(thread).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    step = F.when(F.col("opens"), 1).otherwise(-1)
    rows = events.where("opens is not null").withColumn("_sum", F.sum(step).over(whole)).withColumn("_least", F.least(F.lit(0), F.min("_sum").over(whole)))
    before = F.lag("_sum", 1, 0).over(W.partitionBy(thread).orderBy(*order)) - F.lag("_least", 1, 0).over(W.partitionBy(thread).orderBy(*order))
    # a start is at the depth it reaches, a stop at the depth it leaves; 0 is a stop with nothing open
    rows = rows.withColumn("depth", F.when(F.col("opens"), F.col("_sum") - F.col("_least")).otherwise(before).cast("int")).where("depth > 0")
    level = W.partitionBy(thread, "depth").orderBy(*order)
    ahead = lambda c: F.lead(c).over(level)
    rows = rows.withColumns({"_stops": F.coalesce(~ahead("opens"), F.lit(False)), "_same": ahead("name").eqNullSafe(F.col("name")), "_end": ahead("at")}).where("opens")
    status = F.when(F.col("_stops") & F.col("_same"), "closed").when(F.col("_stops"), "mismatched").otherwise("open")
    spans = rows.select(thread, "seq", "name", "at", *[c for c in order if c not in ("at", "seq")], "depth", status.alias("status"), F.when(status == "closed", F.col("_end") - F.col("at")).alias("duration"))
    # each span is a child at its own depth and stands as parent for the next one
    both = spans.withColumn("_role", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_at_depth", F.col("depth") + F.col("_role"))
    above = W.partitionBy(thread, "_at_depth").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return both.withColumn("parent", F.last(F.when(F.col("_role") == 1, F.col("seq")), ignorenulls=True).over(above)).where("_role = 0").drop("_role", "_at_depth")


def shares(spans: DataFrame, thread: str = "thread", bottleneck: float = 0.7) -> DataFrame:
    """Adds children, self_time (duration less that of closed children), share of the parent's duration (null without one, NaN of 0) and bottleneck."""
    spans = cut(spans)
    kids = spans.where("parent is not null").groupBy(thread, F.col("parent").alias("seq")).agg(F.count(F.lit(1)).alias("children"), F.sum(F.coalesce("duration", F.lit(0))).alias("_below"))
    over = spans.select(thread, F.col("seq").alias("parent"), F.col("duration").alias("_over"))
    rows = spans.join(kids, [thread, "seq"], "left").join(over, [thread, "parent"], "left")
    own = F.coalesce("duration", F.lit(0))
    share = F.when(F.col("_over") == 0, F.lit(float("nan"))).otherwise(own / F.col("_over"))
    rows = rows.withColumns({"children": F.coalesce("children", F.lit(0)), "self_time": F.col("duration") - F.coalesce("_below", F.lit(0)), "share": share})
    return rows.withColumn("bottleneck", F.coalesce((F.col("share") > bottleneck) & ~F.isnan("share"), F.lit(False))).drop("_below", "_over")
