"""Themes that grow with each batch of analyses.

An analysis names a theme and may suggest a parent. In order of ``seq`` it either joins the first theme that
bears the parent's name (letter case aside), if its confidence and the likeness of the two descriptions
are high enough, or founds a theme of its own. A joined theme keeps its name and description, so an
analysis depends on the past only through the first theme of one name. All analyses that
depend on nothing open are settled together, by one join on the name; the number of rounds is the
longest chain of analyses that wait for one another, not their number, and each round works on what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as sim
from .cluster import cut
from .relational import first_wins, ordered_text

THEMES = "seq long, name string, description string, confidence double"


def firsts(themes: DataFrame) -> DataFrame:
    """name_key, seq and description of the first theme of every name."""
    named = themes.select(F.lower(F.coalesce("name", F.lit(""))).alias("name_key"), "seq", F.coalesce("description", F.lit("")).alias("description"))
    return first_wins(named, ["name_key"], ["seq"])


def placed(themes: DataFrame, batch: DataFrame, confidence: float = 0.7, likeness: float = 0.6) -> DataFrame:
    """seq, action (merge or create) and theme (seq of the theme it joins or founds) of every analysis.

    themes: the state, as in ``THEMES``; batch: seq (above all of the state's), name, description, confidence, parent.
    A parent that is null, empty or unknown founds a theme; a null confidence is none; a null description is empty."""
    rows = batch.select(
        "seq", F.lower(F.coalesce("name", F.lit(""))).alias("name_key"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.lower(F.when(F.col("parent") != "", F.col("parent"))).alias("parent_key"),
    )
    known, open_rows = firsts(themes), cut(rows)
    done: list[DataFrame] = []
    while not open_rows.isEmpty():
        # of each name, the first theme or analysis that may become it
        both = known.withColumn("settled", F.lit(True)).unionByName(open_rows.select("name_key", "seq", "description", F.lit(False).alias("settled")))
        first = both.groupBy("name_key").agg(F.min(F.struct("seq", "description", "settled")).alias("p"))
        asked = open_rows.join(first.withColumnRenamed("name_key", "parent_key"), "parent_key", "left")
        before = F.coalesce(F.col("p.seq") < F.col("seq"), F.lit(False))
        score = sim.description_score(F.col("description"), F.coalesce("p.description", F.lit("")))
        joins = before & (F.col("confidence") > confidence) & (score > likeness)
        action = F.when(before & ~F.col("p.settled"), "wait").when(joins, "merge").otherwise("create")
        now = cut(asked.select(*rows.columns, action.alias("action"), F.when(action == "merge", F.col("p.seq")).otherwise(F.col("seq")).alias("theme")))
        settled = now.where("action <> 'wait'")
        done.append(settled.select("seq", "action", "theme"))
        known = cut(known.unionByName(settled.where("action = 'create'").select("name_key", "seq", "description")).groupBy("name_key").agg(F.min_by(F.struct("seq", "description"), "seq").alias("t")).select("name_key", "t.*"))
        open_rows = now.where("action = 'wait'").select(*rows.columns)
    out = rows.select("seq", F.lit("").alias("action"), F.col("seq").alias("theme")).limit(0)
    for part in done:
        out = out.unionByName(part)
    return out


def grown(themes: DataFrame, batch: DataFrame, where: DataFrame) -> DataFrame:
    """The state after a batch: its themes and those that the batch founded."""
    new = batch.join(where.where("action = 'create'").select("seq"), "seq", "left_semi")
    return themes.select("seq", "name", "description", "confidence").unionByName(new.select("seq", "name", "description", F.col("confidence").cast("double").alias("confidence")))


def contents(where: DataFrame, batch: DataFrame) -> DataFrame:
    """Per theme of a batch: members, affected files and context in order, as the theme took them up."""
    rows = where.join(batch, "seq")
    return rows.groupBy("theme").agg(
        F.count(F.lit(1)).alias("members"), F.count_if(F.col("action") == "merge").alias("merged"),
        ordered_text("filename", ["seq"], ",").alias("affected_files"), ordered_text("description", ["seq"], "\n").alias("context"),
    )
