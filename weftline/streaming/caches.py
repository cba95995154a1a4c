"""Streaming counterparts of the cache folds, for logs that arrive without end.

State is kept for each key by ``applyInPandasWithState`` in event-time order within a micro-batch;
a key's state ends once its entry is older than its life by the watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def ttl_hits(events: DataFrame, key: str, ttl_seconds: int, late: str = "10 minutes") -> DataFrame:
    """key, ts, hit for reads with store on miss (a hit does not renew the entry).

    events: ``key`` and ts (event time). Batches must arrive in order for each key; rows later than the
    watermark are dropped, as everywhere in streaming."""

    def fold(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stored = pd.Timestamp(state.get[0]) if state.exists else None
        rows = pd.concat(list(parts)).sort_values("ts", kind="stable")
        hits = []
        for t in rows["ts"]:
            hit = stored is not None and (t - stored).total_seconds() <= ttl_seconds
            stored = stored if hit else t
            hits.append(hit)
        state.update((stored.to_pydatetime(),))
        state.setTimeoutTimestamp(max(int(stored.timestamp() * 1000) + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": k[0], "ts": rows["ts"], "hit": hits})

    kind = events.schema[key].dataType.simpleString()
    return events.withWatermark("ts", late).groupBy(key).applyInPandasWithState(fold, f"key {kind}, ts timestamp, hit boolean", "stored timestamp", "append", GroupStateTimeout.EventTimeTimeout)


def call_counts(calls: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Per context and window: calls, mean and greatest duration, slow calls."""
    found = calls.withWatermark("ts", late).groupBy(F.window("ts", window), "context")
    return found.agg(F.count(F.lit(1)).alias("n"), F.avg("duration_ms").alias("mean_ms"), F.max("duration_ms").alias("max_ms"), F.count_if(F.col("duration_ms") > 5000).alias("n_slow"))
