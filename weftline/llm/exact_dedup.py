"""Exact deduplication by content sort.

Texts are normalised (A-Z lower-cased, null as empty) in the JVM. Sampled splitters deal the rows by
range of (first bytes, 64-bit hash, identifier), a key of bounded size; each partition is sorted
externally by the same bytes, then the whole text, which puts equal texts side by side, and one streaming pass compares
each text with its neighbour in full. The range key ends with the identifier, so a text with any
number of copies is cut over as many partitions as its size asks for. Only the first and last run of
a partition can continue elsewhere: these (at most two rows a partition, so a table bounded by the
number of partitions) are summed by digest and joined back.

Defined cases: null and empty texts are equal; identifiers that repeat are separate rows of one
group; a null identifier comes after all others, so it stays only where a group has no other, and ``deduplicate``,
which drops by identifier, keeps rows without one; an empty table gives an empty result; columns other than the identifier and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, tidy, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX = 48
_RUNS = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string()), ("head_id", pa.int64()), ("part", pa.int64()), ("run", pa.int64()), ("run_size", pa.int64()), ("open", pa.bool_())])


def normalised(text):
    """A-Z to a-z, nothing else. lower() does just that to pure ASCII; other texts go letter by letter."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to rows with their run; the last run of a batch is held back until it ends."""
    previous, digest, run, part = None, "", 0, TaskContext.get().partitionId()
    held: list[pa.Array] = []

    def out(open_run: bool) -> pa.RecordBatch:
        ids = pa.concat_arrays(held)  # Arrow keeps null identifiers, and large ones beside them, as they are
        n = len(ids)
        return pa.record_batch(
            [ids, pa.array([digest] * n, pa.string()), ids.take(pa.array(np.zeros(n, np.int64))), pa.array(np.full(n, part)), pa.array(np.full(n, run)), pa.array(np.full(n, n)), pa.array(np.full(n, open_run))], schema=_RUNS
        )

    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("norm")
        ready: list[pa.RecordBatch] = []
        lo = 0
        for i in range(len(ids)):
            text = texts[i].as_buffer()
            if previous is None or not text.equals(previous):
                if previous is not None:
                    if i > lo:
                        held.append(ids.slice(lo, i - lo))
                    ready.append(out(run == 0))
                    held, run, lo = [], run + 1, i
                previous, digest = text, hashlib.sha256(text).hexdigest()
        held.append(ids.slice(lo))
        if previous is not None:
            previous = pa.py_buffer(previous.to_pybytes())
        if ready:
            yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
    if previous is not None:
        yield out(True)


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", partitions: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` is "min" or "max": which identifier of equal texts stays. Of rows that also share that
    identifier, each counts as kept."""
    sign = 1 if keep == "min" else -1
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    rows = rows.select(F.coalesce(F.col("doc_id") * sign, F.lit((1 << 63) - 1)).alias("_rank"), "doc_id", F.encode("norm", "UTF-8").alias("norm"))
    rows = rows.select("doc_id", "norm", "_rank", F.substring("norm", 1, PREFIX).alias("_head"), F.xxhash64("norm").alias("_hash"))
    n = partitions or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["_head", "_hash", "norm", "_rank"]
    dealt = rows.repartitionByRange(n, "_head", "_hash", "_rank").sortWithinPartitions(*order)
    runs = materialise(dealt.select("doc_id", "norm").mapInArrow(tidy(_runs), "doc_id long, text_sha256 string, head_id long, part long, run long, run_size long, open boolean"), "exact")
    pick = F.min if keep == "min" else F.max
    ends = runs.where("open").select("text_sha256", "head_id", "run_size", "part", "run").distinct()
    ends = ends.groupBy("text_sha256").agg(pick("head_id").alias("all_head"), F.sum("run_size").alias("all_size"))
    keep_id, size = F.coalesce("all_head", "head_id"), F.coalesce("all_size", "run_size")
    # at most two rows for each of n partitions
    found = runs.join(F.broadcast(ends), "text_sha256", "left") if n <= 100_000 else runs.join(ends, "text_sha256", "left")
    return found.select("doc_id", keep_id.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256")


def deduplicate(df: DataFrame, keep: str = "max") -> DataFrame:
    """The rows of ``df`` (all columns) whose text is the kept one of its group; an identifier that
    stands for several texts stays if one of them is kept."""
    ids = exact_groups(df, keep=keep).groupBy("doc_id").agg(F.bool_or("kept").alias("kept"))
    return without(df, materialise(ids.where("NOT kept").select("doc_id"), "dropped"))
