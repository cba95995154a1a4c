"""Cache and queue state as folds over event logs, one fold for each key."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ttl_hits(log: DataFrame, keys: list[str], ts: str, order: str, ttl: int, slots: int = 64) -> DataFrame:
    """Adds ``hit``: reads of a key with store on miss; an entry lives while its age is at most ``ttl``
    and a hit does not renew it.

    Where the gap between two reads exceeds the ttl the later one is a miss whatever came before, so
    the log is cut there. A piece that is over within the ttl has one miss, its first read; only the
    longer pieces are folded, many to a task by hash."""
    w = W.partitionBy(*keys).orderBy(ts, order)
    fresh = F.lag(ts).over(w).isNull() | (F.col(ts) - F.lag(ts).over(w) > ttl)
    rows = log.withColumn("_piece", F.sum(fresh.cast("int")).over(w))
    piece = W.partitionBy(*keys, "_piece")
    rows = rows.withColumn("_from", F.min(ts).over(piece)).withColumn("_long", F.max(ts).over(piece) - F.col("_from") > ttl)
    rows = rows.withColumn("_first", F.row_number().over(piece.orderBy(ts, order)) == 1)
    short = rows.where("NOT _long").select(*log.columns, (~F.col("_first")).alias("hit"))
    long = rows.where("_long").withColumn("_slot", F.pmod(F.xxhash64(*keys, "_piece"), F.lit(slots))).select("_slot", "_piece", *log.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema.fields) + ", hit boolean"

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([*keys, "_piece", ts, order], kind="stable")
        hits, stored, before = [], 0, None
        for place in zip(*[part[c] for c in (*keys, "_piece", ts)], strict=True):
            hit = place[:-1] == before and place[-1] - stored <= ttl
            if not hit:
                stored, before = place[-1], place[:-1]
            hits.append(hit)
        return part.drop(columns=["_slot", "_piece"]).assign(hit=hits)

    return short.unionByName(long.groupBy("_slot").applyInPandas(fold, schema))


def lru(log: DataFrame, key: str, order: str, capacity: int) -> DataFrame:
    """Fold of one cache of ``capacity`` bytes over a log (op get/set, entry, size): adds hit, evicted, used.

    One cache is one serial fold; ``key`` names the caches, which are folded apart."""
    schema = log.schema.simpleString()[7:-1].replace(":", " ") + ",hit boolean,evicted int,used long"

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable")
        live: dict = {}
        used, out = 0, []
        for op, entry, size in zip(part["op"], part["entry"], part["size"], strict=True):
            hit, gone = entry in live, 0
            if hit:
                s = live.pop(entry)
                if op == "set":
                    used -= s
                else:
                    live[entry] = s
            if op == "set" and size <= capacity:
                while used + size > capacity:
                    used -= live.pop(next(iter(live)))
                    gone += 1
                live[entry] = size
                used += size
            out.append((hit, gone, used))
        return part.assign(hit=[o[0] for o in out], evicted=[o[1] for o in out], used=[o[2] for o in out])

    return log.groupBy(key).applyInPandas(fold, schema)


def context_ttl_ms(context: Column) -> Column:
    """Milliseconds that answers of a context are kept (fixed values; one hour by default)."""
    from ..functions.base import lookup

    hour = 3_600_000
    table = {
        "file-analysis": 2 * hour, "domain-classification": 2 * hour, "pattern-recognition": 2 * hour, "similarity-calculation": hour,
        "theme-expansion": hour, "cross-level-analysis": hour // 2, "hierarchy-analysis": hour // 2, "consolidation": hour // 2,
    }
    return lookup(context, table, hour)


def effective_ttl(custom, default, mode: str = "faithful"):
    """Faithful: a longer custom life has no effect; fixed: it has."""
    return F.least(custom, default) if mode == "faithful" else F.coalesce(custom, default)


def memoised(requests: DataFrame, key: list[str], compute) -> DataFrame:
    """Compute once for each distinct key and join back (a cache with in-flight deduplication)."""
    return requests.join(compute(requests.select(*key).distinct()), key, "left")


def retry_schedule(attempts: int, base_ms: int = 1000, cap_ms: int = 10_000) -> list[int]:
    """Waits before the second and later tries: doubling, capped."""
    return [min(base_ms * 2**k, cap_ms) for k in range(attempts - 1)]


def breaker_trips(outcomes: DataFrame, keys: list[str], order: list[str], failing, at: int = 5) -> DataFrame:
    """Runs of failures that reach ``at``: where a circuit breaker would open."""
    from .ordered import islands

    return islands(outcomes, keys, order, failing).where(F.col("length") >= at)


def simulate_queue(log: DataFrame, queue: str, order: str, active: int = 10, spacing_ms: int = 200) -> DataFrame:
    """Start and end of first-in-first-out requests: at most ``active`` at once, starts at least ``spacing_ms`` apart.

    log: ``queue``, ``order``, ts_ms, duration_ms; queues are simulated apart."""
    import heapq

    schema = log.schema.simpleString()[7:-1].replace(":", " ") + ",start_ms long,end_ms long"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable")
        busy: list[int] = []
        last, starts, ends = None, [], []
        for ts, ms in zip(part["ts_ms"], part["duration_ms"], strict=True):
            at = int(ts) if last is None else max(int(ts), last + spacing_ms)
            if len(busy) >= active:
                at = max(at, heapq.heappop(busy))
            heapq.heappush(busy, at + int(ms))
            last = at
            starts.append(at)
            ends.append(at + int(ms))
        return part.assign(start_ms=starts, end_ms=ends)

    return log.groupBy(queue).applyInPandas(run, schema)

