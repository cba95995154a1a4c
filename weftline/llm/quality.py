"""Quality classification by Bradley-Terry pairwise ranking.

Each text becomes a vector of surface measures (letters, symbols, capitals, repetition, line and
word shape), computed for a whole Arrow batch at once. A preference pair is one text of label 1 and
one of label 0; the model P(a preferred to b) = logistic(w . (x_a - x_b)) is fitted by Newton steps
on the logistic loss of the feature differences. The linear score is cut at the quantile of training
scores that the share of label 0 asks for, and passed through a logistic function that puts the cut
at ``THRESHOLD``.

Defined cases: null and empty texts have all-zero measures and get the score these imply; texts of
any length are measured whole; without rows of both labels every score is 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL, documents_only, materialise, slices, tidy, word_hashes, words

THRESHOLD = 0.3
_SLICE = 1 << 18  # keeps a worker's arrays to a few tens of MB
_CLASS = np.zeros((6, 256), bool)
_CLASS[0, 97:123] = _CLASS[0, 128:] = True  # lower case and beyond ASCII
_CLASS[1, 65:91] = True
_CLASS[2, 48:58] = True
_CLASS[3, [33, 39, 44, 46, 58, 59, 63, 45, 34, 40, 41]] = True  # usual punctuation
_CLASS[4, [*range(35, 39), 42, 43, 47, *range(60, 63), 64, *range(91, 97), *range(123, 127)]] = True
_CLASS[5, 10] = True
NAMES = ("lower", "upper", "digit", "punct", "symbol", "length", "words", "word_len", "long", "shouting", "wordless", "tailed", "ended", "stutter", "distinct", "pairs", "lines", "line_words", "lead_upper")


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """texts x measures."""
    docs = len(offsets) - 1
    starts, ends, first = words(data, offsets)
    size, count = np.diff(offsets).astype(float), np.diff(first).astype(float)
    n, w = np.maximum(size, 1), np.maximum(count, 1)
    own = np.repeat(np.arange(docs), np.diff(first))
    running = [np.concatenate([[0], np.cumsum(_CLASS[k][data], dtype=np.int32)]) for k in range(6)]
    whole = [(c[offsets[1:]] - c[offsets[:-1]]) / n for c in running]
    per = [c[ends] - c[starts] for c in running]
    tally = lambda mask: np.bincount(own[mask], minlength=docs)[:docs] / w
    length = ends - starts
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    before = data[np.maximum(ends - 2, starts)] if len(ends) else last
    lead = data[starts] if len(starts) else last
    h = word_hashes(data, starts, ends)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])

    def kinds(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        key = np.unique((of.astype(np.uint64) << np.uint64(40)) | (values >> np.uint64(24)))
        return np.bincount((key >> np.uint64(40)).astype(np.int64), minlength=docs)[:docs]

    pair = h[1:] * np.uint64(0x9E3779B97F4A7C15) + h[:-1]
    inside = own[1:] == own[:-1]
    lines = 1 + (running[5][offsets[1:]] - running[5][offsets[:-1]])
    ok = count > 0
    out = [
        *whole[:5], np.log1p(size), np.log1p(count), np.where(ok, (size / w), 0), tally(length > 20), tally((per[1] >= 2) & (per[0] == 0)),
        tally((per[0] == 0) & (per[1] == 0)), tally(_CLASS[4][last] | (last == before) & ~_CLASS[0][last]), tally((last == 46) | (last == 44)), tally(same),
        np.where(ok, kinds(h, own) / w, 0), np.where(count > 1, kinds(pair[inside], own[1:][inside]) / np.maximum(count - 1, 1), 0),
        np.log1p(lines), np.log1p(count / lines), tally(_CLASS[1][lead]),
    ]
    x = np.column_stack(out)
    return np.column_stack([x, np.sqrt(np.maximum(x, 0)), x[:, 14] * x[:, 6], x[:, 15] * x[:, 6]])


class Ranker:
    def __init__(self, size: int = 0):
        self.mean, self.spread, self.weights = np.zeros(size), np.ones(size), np.zeros(size)
        self.cut, self.scale, self.fitted = 0.0, 1.0, False

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.zeros(len(x))
        s = self.scaled(x) @ self.weights
        return 1 / (1 + np.exp(-np.clip((s - self.cut) / self.scale + np.log(THRESHOLD / (1 - THRESHOLD)), -40, 40)))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in slices(batch, "text", _SLICE):
            x = measures(data, offsets)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), batch.column("y").slice(lo, hi - lo), flat], names=["doc_id", "y", "x"])


def _sums(of):
    """One row of the task's sums of ``of(y, x)`` over its rows; a group's rows follow one another and meet in one call."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = None, None
        for batch in _with_end(batches):
            if batch is not None and not batch.num_rows:
                continue
            if batch is not None:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
                now = (batch.column("g").to_numpy(), batch.column("y").to_numpy(), x)
                held = now if held is None else tuple(np.concatenate(c) for c in zip(held, now, strict=True))
            if held is None:
                continue
            g, y, x = held
            edges = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
            whole = len(edges) - 1 if batch is None else len(edges) - 2  # the last group may go on
            for lo, hi in zip(edges[:whole], edges[1 : whole + 1], strict=True):
                part = of(y[lo:hi], x[lo:hi])
                total = part if total is None else total + part
            held = tuple(c[edges[whole] :] for c in held)
        if total is not None:
            yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    return run


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _summed(rows: DataFrame, of) -> np.ndarray:
    """Sums over all tasks, the same in whatever order they end."""
    parts = [r["sums"] for r in rows.select("g", "y", "x").mapInArrow(tidy(_sums(of)), "sums array<double>").collect()]
    return np.array([math.fsum(c) for c in zip(*parts, strict=True)])


def _newton(ranker: Ranker, w: np.ndarray):
    """Gradient and curvature of the logistic loss of all pairs (label 1, label 0) of a group, as one row."""

    def of(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        x = ranker.scaled(x)
        up, down = x[y == 1], x[y == 0]
        p = 1 / (1 + np.exp(np.clip((up @ w)[:, None] - (down @ w)[None, :], -30, 30)))  # chance that the pair is ranked wrongly
        v = p * (1 - p)
        across = up.T @ v @ down
        bend = (up * v.sum(1)[:, None]).T @ up + (down * v.sum(0)[:, None]).T @ down - across - across.T
        return np.concatenate([[p.size], up.T @ p.sum(1) - down.T @ p.sum(0), bend.ravel()])

    return of


def _at_rank(scores: DataFrame, ranks: list[int]) -> list[float]:
    """Scores at these places (from 0) in ascending order: histograms of ever narrower ranges, nothing is sorted in one task."""
    out = []
    for rank in ranks:
        rest = scores
        while True:
            low, high = rest.agg(F.min("s"), F.max("s")).first()
            if low == high:
                break
            width = (high - low) / 4096
            cell = F.least(F.lit(4095), F.floor((F.col("s") - low) / width)).cast("int")
            for row in sorted(rest.groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("a"), F.max("s").alias("b")).collect()):
                if rank < row["n"]:
                    break
                rank -= row["n"]
            rest = rest.where(F.col("s").between(row["a"], row["b"]))
        out.append(float(low))
    return out


GROUP = 512  # rows of which all pairs of different labels are compared


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", ridge: float = 3.0, pairs: int = 60_000) -> Ranker:
    """Ranker from documents and their labels (doc_id, ``label`` 0/1), all of them.

    Rows fall into groups of about ``GROUP`` by identifier hash, and within a group each text of label 1 makes a pair with each
    of label 0, so every labelled text counts and pairs grow with the rows. ``pairs``: the weight of all of them against
    ``ridge``. Only sums reach the driver."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)").dropDuplicates(["doc_id"])
    n = known.count()
    if not n:
        return Ranker()
    known = F.broadcast(known) if n <= SMALL else known
    found = documents_only(docs).join(known, "doc_id").mapInArrow(tidy(_measured), "doc_id long, y int, x array<double>")
    groups = max(1, n // GROUP)
    found = found.withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    rows = materialise(found.repartition(max(1, groups // 32), "g").sortWithinPartitions("g", "doc_id", "y", "x"), "measures")
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Ranker()
    total, low = sum(sizes.values()), sizes[0] / sum(sizes.values())
    mean = _summed(rows, lambda y, x: x.sum(0)) / total
    ranker = Ranker(len(mean))
    ranker.mean, ranker.spread = mean, np.sqrt(_summed(rows, lambda y, x: ((x - mean) ** 2).sum(0)) / total) + 1e-6
    w = np.zeros(len(mean))
    for _ in range(40):
        sums = _summed(rows, _newton(ranker, w))
        if not sums[0]:  # no group has both labels
            return Ranker()
        slope, bend = sums[1 : len(w) + 1] * pairs / sums[0], sums[len(w) + 1 :].reshape(len(w), -1) * pairs / sums[0]
        step = np.linalg.solve(bend + ridge * np.eye(len(w)), slope - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    ranker.weights, ranker.fitted = w, True

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, len(w))
            yield pa.record_batch([pa.array(ranker.scaled(x) @ w)], names=["s"])

    scores = materialise(rows.select("x").mapInArrow(tidy(scored), "s double"), "scores")
    # the cut lies between the scores around the quantile that the share of label 0 asks for
    ranks = [min(total - 1, max(0, math.ceil(q * total) - 1)) for q in (low - 1e-9, min(1.0, low + 0.005))]
    ranker.cut = float(np.mean(_at_rank(scores, ranks)))
    ranker.scale = float(max(1e-6, scores.agg(F.stddev_pop("s")).first()[0]) / 3)
    return ranker


def score(df: DataFrame, ranker: Ranker) -> DataFrame:
    """doc_id, score and predicted for every row."""
    shared = df.sparkSession.sparkContext.broadcast(ranker)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch, "text", _SLICE):
                s = shared.value.score(measures(data, offsets))
                yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, score double, predicted int")
