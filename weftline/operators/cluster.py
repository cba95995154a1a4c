"""Greedy leader clustering.

In input order each unclaimed item leads and claims every unclaimed item that is similar enough to
it. The result depends on order and is not transitive. The fold is serial only inside a connected
component of the similarity graph, so components are found first and folded apart. A component
larger than ``limit`` edges is folded by rounds of joins instead of in one task."""

from __future__ import annotations

import os
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_dir(df: DataFrame) -> str:
    """The checkpoint folder that the cluster shares (spark.checkpoint.dir); a local one only where unset."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        at = context.getConf().get("spark.checkpoint.dir")
        if not at and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(at or os.path.join(tempfile.gettempdir(), "weftline-checkpoints"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder."""
    shared_dir(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder: worked out once, and smaller than a checkpoint where values repeat."""
    at = f"{shared_dir(df)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def components(edges: DataFrame) -> DataFrame:
    """node, component (least node) of undirected edges (a, b)."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).withColumnRenamed("a", "node")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("m")).withColumnRenamed("a", "node")
        new = cut(label.join(near, "node").select("node", F.least("c", "m").alias("c"), (F.col("m") < F.col("c")).alias("moved")))
        label = new.select("node", "c")
        if new.where("moved").isEmpty():
            return label.withColumnRenamed("c", "component")


def _fold(part: pd.DataFrame) -> pd.DataFrame:
    near: dict = {}
    for a, b in zip(part["a"], part["b"], strict=True):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    leader: dict = {}
    for x in sorted(near):
        if x in leader:
            continue
        leader[x] = x
        for y in near[x]:
            if y > x:
                leader.setdefault(y, x)
    return pd.DataFrame({"item": list(leader), "leader": list(leader.values())})


def leaders(items: DataFrame, edges: DataFrame, ordinal: str, limit: int = 1_000_000) -> DataFrame:
    """item, leader for every item; ``edges`` (a < b) are pairs at or above the threshold, by ordinal.

    While there are more than ``limit`` edges and a tenth of them goes each time, whoever has no smaller open neighbour leads and
    leaves with all its neighbours, and only edges between open items stay. An item's leader is the least of its leading neighbours."""
    every = stored(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    rest, n, found = every, every.count(), []
    while n > limit:
        found.append(stored(rest.select("a").distinct().join(hinted(rest.select(F.col("b").alias("a")).distinct()), "a", "left_anti")))
        taken = rest.join(hinted(found[-1]), "a", "left_semi").select(F.col("b").alias("a")).distinct()
        gone = hinted(stored(found[-1].unionByName(taken)))
        rest = stored(rest.join(gone, "a", "left_anti").join(gone.withColumnRenamed("a", "b"), "b", "left_anti").select("a", "b"))
        before, n = n, rest.count()
        if n > 0.9 * before:
            break
    last = _folded(rest, limit).where("item = leader").select(F.col("item").alias("a"))
    for lead in found:
        last = last.unionByName(lead)
    lead = hinted(stored(last))
    own = every.join(lead, "a", "left_semi").groupBy("b").agg(F.min("a").alias("leader")).withColumnRenamed("b", "item")
    own = own.join(lead.withColumnRenamed("a", "item"), "item", "left_anti")
    return items.select(F.col(ordinal).cast("long").alias("item")).join(own, "item", "left").select("item", F.coalesce("leader", "item").alias("leader"))


def hinted(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """Broadcast hint for a column of identifiers that is counted to be short."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _folded(edges: DataFrame, limit: int) -> DataFrame:
    """item, leader by components, each in one task, or by rounds where it has over ``limit`` edges."""
    parts = components(edges)
    tagged = edges.join(parts.withColumnRenamed("node", "a"), "a")
    size = tagged.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    tagged = tagged.join(size, "component")
    folded = tagged.where(F.col("n") <= limit).select("component", "a", "b").groupBy("component").applyInPandas(_fold, "item long, leader long")
    big = tagged.where(F.col("n") > limit).select("a", "b")
    return folded if big.isEmpty() else folded.unionByName(leaders_by_rounds(big))


def leaders_by_rounds(edges: DataFrame) -> DataFrame:
    """The same fold as rounds of joins. An item leads once it has no leading neighbour and no smaller
    open one; it is claimed by its least leading neighbour once no open neighbour is smaller than that
    (one might still come to lead and would have been first). The least open item always settles."""
    pair = edges.select(F.col("a").cast("long").alias("x"), F.col("b").cast("long").alias("y"))
    near = cut(pair.unionByName(pair.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    state = cut(near.select("x").distinct().select("x", F.lit(None).cast("long").alias("leader")))
    while True:
        other = state.select(F.col("x").alias("y"), (F.col("leader") == F.col("x")).alias("leads"), F.col("leader").isNull().alias("open"))
        seen = near.join(other, "y").groupBy("x").agg(F.min(F.when(F.col("leads"), F.col("y"))).alias("m_lead"), F.min(F.when(F.col("open") & (F.col("y") < F.col("x")), F.col("y"))).alias("m_open"))
        claim = F.when(F.col("m_open").isNull() | (F.col("m_lead") < F.col("m_open")), F.coalesce("m_lead", "x"))
        state = cut(state.join(seen, "x").select("x", F.coalesce("leader", claim).alias("leader")))
        if state.where("leader IS NULL").isEmpty():
            return state.select(F.col("x").alias("item"), "leader")
