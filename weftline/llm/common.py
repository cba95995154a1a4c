"""Shared plumbing: table reading, shared scratch tables and vectorised word hashing.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``. A whole Arrow batch is hashed at
once: a prefix sum of ``table[byte] * B**i`` (mod 2**64) gives every word's polynomial hash as one
subtraction, so no Python loop runs over words.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
SLICE_ROWS = 1 << 13
_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_GAMMA = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``; a local one only where unset."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "weftline-shared")
    return at.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/weftline/{label}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, at: str | None) -> None:
    """Delete a folder that ``scratch`` named and that nothing reads any more."""
    if at:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut and a lost
    executor costs no recomputation."""
    spark = df.sparkSession
    at = scratch(spark, label)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def release(spark: SparkSession) -> None:
    """Have the executors collect garbage, so that the heap a stage has grown goes back to the system
    before the next one's Python workers need memory beside it. A few tasks a core reach every executor."""
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("done")).write.format("noop").mode("overwrite").save()


def settle(spark: SparkSession) -> None:
    """Have the driver collect garbage: the plans of many small jobs, and what their broadcasts and shuffles held, go
    before its heap grows for them."""
    spark.sparkContext._jvm.System.gc()


def tidy(run):
    """``run`` over a partition's batches; afterwards freed memory goes back to the system, since a
    Python worker lives on for other tasks beside the executor's heap."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _POWERS.clear()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return tidied


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of at most ``SLICE_ROWS`` rows holding about ``limit`` bytes; null is empty.

    A text longer than ``limit`` forms a slice of its own, whole."""
    col = batch.column(text)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    if col.null_count:
        col = col.fill_null(b"")
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = min(lo + SLICE_ROWS, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_GAMMA[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_GAMMA[1])
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


@lru_cache(maxsize=2)
def _byte_table(which: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE[which]))


def powers(which: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; one pair of arrays each, as long as the partition has needed."""
    found = _POWERS.get(which)
    if found is None or len(found[0]) < need:
        size = 1 << max(16, int(need).bit_length())
        both = []
        for b in (_BASE[which], pow(_BASE[which], -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        found = _POWERS[which] = (both[0], both[1])
    return found


def ranges_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """Hash of values[starts:ends] for every range, position independent."""
    up, down = powers(which, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + np.uint64(_BASE[1 - which]) * (ends - starts).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of all words; document d has words first[d]:first[d + 1]."""
    space = _SPACE[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = space[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(edge[:-1] & ~space)
    edge[:-1] = space
    edge[offsets] = True
    ends = np.flatnonzero(edge[1:] & ~space) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return ranges_hash(_byte_table(which)[data], starts, ends, which)


def grams(hashes: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hash of hashes[i : i + n] for every i that has n values after it."""
    at = np.arange(max(0, len(hashes) - n + 1))
    return ranges_hash(hashes, at, at + n, which)


def documents_only(df: DataFrame, *extra: str) -> DataFrame:
    """doc_id and text (null stays null); other columns are dropped so that none can clash."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: dict[int, int]) -> DataFrame:
    """doc_id, text and y (0/1) of about ``rows[y]`` labelled documents a label, by identifier hash.

    Only the labels are counted and thinned; what is left of them has a size bounded by ``rows`` and
    is broadcast, so no text is shuffled."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)").dropDuplicates(["doc_id"])
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {y: min(1 << 30, -(-(n << 30) // max(1, sizes.get(y, 0)))) for y, n in rows.items()}
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.when(F.col("y") == 1, share[1]).otherwise(share[0]))
    return documents_only(docs).join(F.broadcast(picked), "doc_id")


SMALL = 200_000


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not in ``dropped`` (distinct). The list is broadcast only if it
    is counted to hold at most ``SMALL`` identifiers; beyond that both sides are shuffled."""
    gone = dropped.select("doc_id")
    return docs.join(F.broadcast(gone) if gone.count() <= SMALL else gone, "doc_id", "left_anti")
