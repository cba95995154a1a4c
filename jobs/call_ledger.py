"""Call ledger: time, slow calls, share and error streaks of every day and context, kept up to date.

The source is a log (Parquet) with event_id, ts, user_id, event_type and value. Identifiers grow with
arrival; times need not. A run reads the rows above its high-water mark, finds the days they fall on,
computes these days anew from all rows up to the new mark, replaces their partitions
``output/day=<d>`` and then records the mark. A run that fails before the last step is repeated by the next
one with the same outcome, since days are computed and not added to. Marks are appended; the greatest holds.

Columns of a day and context: calls, total_ms, mean_ms, max_ms, slowest (the least event_id of the slowest), slow_calls (over
``slow_ms``), share of the day's time and bottleneck (over 0.7 of it); and of the day: error_streaks (unbroken errors of a
user, at least ``streak`` of them) and longest_streak. Durations are whole hundredths of ``value`` in milliseconds,
so that sums are exact. Rows without event_id or ts are left out, a null value counts as 0, null contexts are one context and null users one user.

    python -m jobs.call_ledger --config jobs/call_ledger.json --source ... --output ... --state ...
"""

from __future__ import annotations

import datetime as dt
import logging
import os
import sys

if __package__ in (None, ""):  # started as a file
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, read_or_empty
from weftline.operators import metrics, ordered, relational

LOG = logging.getLogger("call_ledger")
MARKS = "mark long, rows long, days long"
LEDGER = (
    "context string, calls long, total_ms long, mean_ms double, max_ms long, slowest long, slow_calls long, share double, bottleneck boolean, "
    "error_streaks long, longest_streak long, day date"
)


def ledger(calls: DataFrame, slow_ms: int = 5000, streak: int = 3) -> DataFrame:
    """The ledger's rows of all days of ``calls`` (event_id, ts, day, user_id, context, ms).

    Days and contexts are summed map-side, so neither a day nor a context meets in one task; streaks
    are runs within a user's day."""
    per = calls.groupBy("day", "context").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("ms").alias("total_ms"), F.max("ms").alias("max_ms"),
        F.min_by("event_id", F.struct(-F.col("ms"), "event_id")).alias("slowest"), F.count_if(F.col("ms") > slow_ms).alias("slow_calls"),
    )
    per = metrics.stage_shares(per, "day", "total_ms").withColumn("mean_ms", F.col("total_ms") / F.col("calls"))
    runs = ordered.islands(calls.select("day", "user_id", "ts", "event_id", "context"), ["day", "user_id"], ["ts", "event_id"], F.coalesce(F.col("context") == "error", F.lit(False)))
    runs = runs.groupBy("day").agg(F.count_if(F.col("length") >= streak).alias("error_streaks"), F.max("length").cast("long").alias("longest_streak"))
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("error_streaks", "longest_streak")}
    return per.join(runs, "day", "left").withColumns(zero).withColumn("share", F.round("share", 9)).select(*[c.split()[0] for c in LEDGER.split(", ")])


def calls_of(log: DataFrame) -> DataFrame:
    ms = F.coalesce(F.round(F.col("value") * 100).cast("long"), F.lit(0).cast("long"))
    rows = log.select(F.col("event_id").cast("long").alias("event_id"), "ts", F.col("user_id"), F.col("event_type").cast("string").alias("context"), ms.alias("ms"))
    return rows.where("event_id is not null and ts is not null").withColumn("day", F.to_date("ts"))


def run(spark: SparkSession, source: str, output: str, state: str, slow_ms: int = 5000, streak: int = 3) -> DataFrame:
    """Bring the ledger up to the last row of ``source`` and return the whole of it."""
    mark = read_or_empty(spark, f"{state}/marks", MARKS).agg(F.max("mark")).first()[0]
    every = calls_of(spark.read.parquet(source))
    new = every if mark is None else every.where(F.col("event_id") > mark)
    found = new.agg(F.max("event_id").alias("mark"), F.count(F.lit(1)).alias("rows"), F.min("day").alias("low"), F.max("day").alias("high"), F.count_distinct("day").alias("days")).first()
    if found["rows"]:
        days = new.where(F.col("event_id") <= found["mark"]).select("day").distinct()
        days = F.broadcast(days) if found["days"] <= 100_000 else days
        kind = every.schema["ts"].dataType
        span = (F.col("ts") >= F.lit(found["low"]).cast(kind)) & (F.col("ts") < F.lit(found["high"] + dt.timedelta(days=1)).cast(kind))  # reaches the scan
        rows = ledger(relational.covered(every.where(span & (F.col("event_id") <= found["mark"])), days, ["day"]), slow_ms, streak)
        rows.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(output)
        spark.createDataFrame([(found["mark"], found["rows"], found["days"])], MARKS).coalesce(1).write.mode("append").parquet(f"{state}/marks")
        LOG.info("read %d new rows of %s up to %d; wrote %d days to %s", found["rows"], source, found["mark"], found["days"], output)
    else:
        LOG.info("nothing new in %s above %s", source, mark)
    return read_or_empty(spark, output, LEDGER)


if __name__ == "__main__":
    command_line("call ledger", run, os.path.join(os.path.dirname(os.path.abspath(__file__)), "call_ledger.json"), ["source", "output", "state"])
