"""Substring deduplication over a log-structured fingerprint index.

A window is ``WIDTH`` consecutive words. Equal windows contain the same least ``GRAM``-word hash (their
minimiser) at the same offset, so an index of minimisers, about two for every 29 words, meets every
repeated window. All windows around one occurrence of a minimiser form its zone, which has a content
hash of its own.

Each batch of documents adds one immutable run to the index: fingerprint, number of occurrences and
least and greatest zone hash, bucketed and sorted by fingerprint, so that a new run is merge-joined
with the historical ones without another exchange; runs are compacted by merging. Of a fingerprint
that occurs again, every zone whose content occurs again is repeated as a whole. Where the zones of
a fingerprint differ (the edges of shared passages) one zone of each content is taken back to its
text and its windows are hashed one by one (96 bits) and counted. Words under a window that starts
elsewhere too are removed.

Counts are pre-aggregated before every exchange, so a passage that a third of all documents share
costs its partition no more than any other; joins on fingerprints and windows are ordinary equi-joins
whose hot keys adaptive execution splits.

Defined cases: null and empty texts have no words and the digest of the empty string; texts of fewer
than ``WIDTH`` words keep everything; a window repeated inside one document is removed there;
identifiers must be unique, as places of equal identifiers count as one document's. The windows of a row
without identifier count, but it keeps all its own words, since places are joined by identifier.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents_only, grams, materialise, ranges_hash, slices, tidy, word_hashes, words

WIDTH, GRAM = 35, 8
_SLICE = 1 << 19  # keeps a worker's arrays to a few tens of MB
#: A fingerprint is hot if it has at least this share of all occurrences; there are at most 1 / HOT such.
HOT = 1e-4


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value of values[i : i + width], by doubling."""
    best, at, span = values, np.arange(len(values), dtype=np.int32), 1
    while span < width:
        jump = min(span, width - span)
        take = best[jump:] < best[:-jump]
        at = np.where(take, at[jump:], at[:-jump])
        best = np.where(take, best[jump:], best[:-jump])
        span += jump
    return at


def _owners(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))


def minimisers(hashes: np.ndarray, own: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hashes, starts of whole windows, place of each window's minimiser)."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    g = grams(hashes, gram)
    at = sliding_argmin(g, width - gram + 1)
    start = np.flatnonzero(own[: len(at)] == own[width - 1 : width - 1 + len(at)])
    return g, start, at[start]


def _anchors(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, data, offsets in slices(batch, "text", _SLICE):
                starts, ends, first = words(data, offsets)
                own = _owners(first)
                h = word_hashes(data, starts, ends)
                g, start, at = minimisers(h, own, width, gram)
                if not len(at):
                    continue
                head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (own[at[1:]] != own[at[:-1]])]))
                size = np.diff(np.append(head, len(at)))
                begin, doc = start[head], own[at[head]]
                zone = ranges_hash(h, begin, begin + size - 1 + width, 1)
                cols = [g[at[head]].view(np.int64), zone.view(np.int64), ids.slice(lo, hi - lo).take(pa.array(doc)), (begin - first[doc]).astype(np.int32), size.astype(np.int32)]
                yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=["fp", "zone", "doc_id", "start", "size"])

    return run


def _zone_windows(width: int):
    """Documents with zones (starts, sizes, counts of their contents) to the zones' windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            zones = batch.column("zones")
            per, flat = zones.value_lengths().to_numpy(zero_copy_only=False), zones.flatten()
            begin, size, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            cuts = np.concatenate([[0], np.cumsum(per)])
            for lo, hi, data, offsets in slices(batch, "text", _SLICE):
                starts, ends, first = words(data, offsets)
                z = slice(cuts[lo], cuts[hi])
                doc = np.repeat(np.arange(hi - lo), per[lo:hi])
                count = size[z]
                at = np.repeat(begin[z] + first[doc], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                doc, alone = np.repeat(doc, count), np.repeat(n[z] == 1, count)
                one = ranges_hash(word_hashes(data, starts, ends), at, at + width, 0)
                two = ranges_hash(word_hashes(data, starts, ends, 1), at, at + width, 1) >> np.uint64(32)
                cols = [one.view(np.int64), two.astype(np.uint32).view(np.int32), ids.slice(lo, hi - lo).take(pa.array(doc)), (at - first[doc]).astype(np.int32), alone]
                yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=["w1", "w2", "doc_id", "start", "alone"])

    return run


def _removed(width: int):
    """Documents with zones of repeated windows to what is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                kept, total, gone = [], [], []
                for text, zones in zip(part.column("text"), part.column("zones"), strict=True):
                    own = (text.as_py() or "").encode().split()
                    left = own
                    if zones.is_valid:
                        begin, size = (zones.values.field(k).to_numpy(zero_copy_only=False) for k in range(2))
                        drop = np.zeros(len(own) + 1, np.int32)
                        np.add.at(drop, begin, 1)
                        np.add.at(drop, begin + size - 1 + width, -1)
                        cover = np.cumsum(drop[:-1]) > 0
                        left = [w for w, c in zip(own, cover.tolist(), strict=True) if not c]
                    kept.append(b" ".join(left))
                    total.append(len(own))
                    gone.append(len(own) - len(left))
                cols = [part.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array([k.decode() for k in kept], pa.string()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
                yield pa.record_batch(cols, names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    return run


class FingerprintIndex:
    """Sorted immutable runs of (fp, n, low, high); a run is a table bucketed and sorted by fp.

    ``high`` is null where all zones of a fingerprint have one content."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, width: int = WIDTH, gram: int = GRAM):
        self.spark, self.width, self.gram = spark, width, gram
        self.buckets = buckets
        self.name = f"fingerprints_{uuid.uuid4().hex[:12]}"
        self.runs: list[str] = []
        self.made = 0

    def _write(self, df: DataFrame) -> str:
        name = f"{self.name}_{self.made}"
        self.made += 1
        # few buckets: tasks are merged and each writes a part of every bucket; many: one file a bucket
        dealt = df.coalesce(self.buckets) if self.buckets <= 16 else df.repartition(self.buckets, "fp")
        dealt.sortWithinPartitions("fp").write.bucketBy(self.buckets, "fp").sortBy("fp").format("parquet").saveAsTable(name)
        return name

    def anchors(self, docs: DataFrame) -> DataFrame:
        """fp, zone, doc_id, start and size of every minimiser of a batch."""
        return documents_only(docs).mapInArrow(tidy(_anchors(self.width, self.gram)), "fp long, zone long, doc_id long, start int, size int")

    def append(self, anchors: DataFrame) -> str:
        """Add a batch's fingerprints as a new run."""
        self.buckets = self.buckets or max(6, anchors.count() // 1_000_000)
        run = anchors.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("zone").alias("low"), F.max("zone").alias("high"))
        self.runs.append(self._write(run.withColumn("high", F.nullif("high", F.col("low")))))
        return self.runs[-1]

    def _merged(self, a: str, b: str) -> DataFrame:
        old = self.spark.table(a).hint("merge")
        new = self.spark.table(b).select("fp", *[F.col(c).alias(f"new_{c}") for c in ("n", "low", "high")])
        low, high = F.least("low", "new_low"), F.greatest("low", "high", "new_low", "new_high")
        n = F.coalesce("n", F.lit(0)) + F.coalesce("new_n", F.lit(0))
        return old.join(new, "fp", "full").select("fp", n.alias("n"), low.alias("low"), F.nullif(high, low).alias("high"))

    def seen_before(self, run: str) -> DataFrame:
        """Fingerprints of ``run`` that repeat in it or occur in an older run (merge joins)."""
        new = self.spark.table(run)
        out = new.where("n > 1").select("fp")
        for old in self.runs[: self.runs.index(run)]:
            out = out.unionByName(new.hint("merge").join(self.spark.table(old).select("fp"), "fp", "left_semi").select("fp"))
        return out.distinct()

    def compact(self) -> None:
        """Merge all runs into one."""
        while len(self.runs) > 1:
            merged = self._write(self._merged(*self.runs[:2]))
            for old in self.runs[:2]:
                self.spark.sql(f"DROP TABLE {old}")
            self.runs = [merged, *self.runs[2:]]

    def repeated(self) -> DataFrame:
        """fp, n and mixed (its zones differ) of fingerprints that occur more than once so far."""
        self.compact()
        return self.spark.table(self.runs[0]).where("n > 1").select("fp", "n", F.col("high").isNotNull().alias("mixed"))

    def drop(self) -> None:
        for run in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        self.runs = []


def repeated_zones(docs: DataFrame, anchors: DataFrame, repeated: DataFrame, width: int = WIDTH, files: int = 6) -> DataFrame:
    """doc_id and zones (array of start, size): the windows that start anywhere else too."""
    # occurrences of hot fingerprints are found on the map side: those are at most 1 / HOT rows
    cut = max(1000, int(HOT * anchors.count()))
    hot = F.broadcast(repeated.where(F.col("n") >= cut).select("fp", "mixed"))
    cold = repeated.where(F.col("n") < cut).select("fp", "mixed")
    again = anchors.join(hot, "fp").unionByName(anchors.join(hot.select("fp"), "fp", "left_anti").join(cold, "fp"))
    again = materialise(again.drop("fp").repartition(files), "again")
    whole = again.where("not mixed").select("doc_id", "start", "size")
    contents = again.where("mixed").groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "start", "size")).alias("z"))
    contents = materialise(contents.select("zone", "n", "z.doc_id", "z.start", "z.size").repartition(files), "zones")
    copied = again.where("mixed").join(contents.where("n > 1").select("zone"), "zone", "left_semi").select("doc_id", "start", "size")
    near = contents.groupBy("doc_id").agg(F.collect_list(F.struct("start", "size", "n")).alias("zones"))
    near = documents_only(docs).join(near, "doc_id").mapInArrow(tidy(_zone_windows(width)), "w1 long, w2 int, doc_id long, start int, alone boolean")
    near = materialise(near.repartition(files), "windows")
    twice = near.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("m"), F.bool_or("alone").alias("some")).where("m > 1 and some").select("w1", "w2")
    single = near.where("alone").join(twice, ["w1", "w2"], "left_semi").select("doc_id", "start", F.lit(1).alias("size"))
    every = whole.unionByName(copied).unionByName(single)
    return every.groupBy("doc_id").agg(F.collect_list(F.struct("start", "size")).alias("zones"))


def remove_repeats(docs: DataFrame, batches: int = 2, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept, kept_sha256 for every document.

    The documents enter the index in ``batches`` batches, by identifier hash."""
    index = FingerprintIndex(docs.sparkSession, width=width, gram=gram)
    anchors = materialise(index.anchors(docs), "anchors")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    for i in range(batches):
        index.append(anchors.where(part == i))
    zones = materialise(repeated_zones(docs, anchors, index.repeated(), width, index.buckets).repartition(index.buckets), "starts")
    index.drop()
    return documents_only(docs).join(zones, "doc_id", "left").mapInArrow(tidy(_removed(width)), "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
