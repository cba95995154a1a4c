"""Span queries over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spans
from .tables import read


def span_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's signups, views and clicks start spans, purchases and errors stop them; the name is the parity of the value's whole part."""
    ev = read(spark, sf_dir, "events")
    rows = ev.select(
        F.col("user_id").alias("thread"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (F.floor("value") % 2).cast("string").alias("name"),
        F.col("event_type").isin("signup", "view", "click").alias("opens"),
    )
    found = spans.shares(spans.nested(rows))
    return found.select("thread", "seq", "parent", "depth", "status", "duration", "children", "self_time", F.round("share", 9).alias("share"), "bottleneck")


SPANS_SQL = """
WITH e AS (SELECT user_id AS thread, event_id AS seq, epoch_us(ts) AS us, floor(value)::BIGINT % 2 AS name, event_type IN ('signup', 'view', 'click') AS opens FROM events),
s AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE -1 END) OVER (PARTITION BY thread ORDER BY us, seq) AS total FROM e),
m AS (SELECT *, least(0, min(total) OVER (PARTITION BY thread ORDER BY us, seq ROWS UNBOUNDED PRECEDING)) AS low FROM s),
d AS (SELECT *, total - low AS after, coalesce(lag(total - low) OVER (PARTITION BY thread ORDER BY us, seq), 0) AS before FROM m),
r AS (SELECT *, CASE WHEN opens THEN after ELSE before END AS depth FROM d),
l AS (SELECT *, lead(opens) OVER w AS nopens, lead(name) OVER w AS nname, lead(us) OVER w AS nus FROM r WHERE depth > 0 WINDOW w AS (PARTITION BY thread, depth ORDER BY us, seq)),
o AS (SELECT thread, seq, us, depth, CASE WHEN nopens IS NULL OR nopens THEN 'open' WHEN nname = name THEN 'closed' ELSE 'mismatched' END AS status, CASE WHEN NOT nopens AND nname = name THEN nus - us END AS duration FROM l WHERE opens),
p AS (SELECT c.thread, c.seq, max({'u': q.us, 'seq': q.seq}).seq AS parent FROM o c JOIN o q ON q.thread = c.thread AND q.depth = c.depth - 1 AND (q.us, q.seq) < (c.us, c.seq) GROUP BY 1, 2),
t AS (SELECT o.*, parent FROM o LEFT JOIN p USING (thread, seq)),
k AS (SELECT thread, parent AS seq, count(*) AS children, sum(coalesce(duration, 0)) AS below FROM t WHERE parent IS NOT NULL GROUP BY ALL)
SELECT t.thread, t.seq, t.parent, t.depth::INT AS depth, t.status, t.duration, coalesce(children, 0) AS children, (t.duration - coalesce(below, 0))::BIGINT AS self_time,
       round(CASE WHEN q.duration = 0 THEN 'NaN'::DOUBLE ELSE coalesce(t.duration, 0) / q.duration END, 9) AS share, coalesce(coalesce(t.duration, 0) / nullif(q.duration, 0) > 0.7::DOUBLE, false) AS bottleneck
FROM t LEFT JOIN k USING (thread, seq) LEFT JOIN t q ON q.thread = t.thread AND q.seq = t.parent
"""

QUERIES = {"span_nesting": span_nesting}
ORACLES = {"span_nesting": SPANS_SQL}
