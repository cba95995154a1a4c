"""Toxicity by compression distance.

Two zstandard dictionaries are made on a bounded sample of labelled texts: one trained on windows of
ordinary text, and one for toxic text. Since toxic documents are mostly ordinary language, a
dictionary trained on them as they are differs from the ordinary one chiefly by noise; so the toxic
one is the ordinary dictionary followed by the strings that toxic texts are enriched in. A window
then compresses shorter with it only if it holds such strings. Window by window the compressed
lengths are compared under several compressor settings, and what the differences look like over the
whole text goes through a logistic calibration fitted on sample rows by dictionaries that they made no part of.

Defined cases: null and empty texts have one empty window and get the score of a text without any
toxic window; texts of any length are compared whole; without rows of both labels every score is 0.
"""

from __future__ import annotations

import os
import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, tidy

WIDTH, STEP = 64, 48
GRAM, ENRICHED, SHARE = 5, 20.0, 0.04
#: (dictionary with entropy tables, strategy, search log): raw or trained, double-fast or greedy
SETTINGS = ((False, 2, 1), (False, 3, 4), (True, 3, 4))
THRESHOLD = 0.3


def _windows(text: bytes) -> list[bytes]:
    return [text[i : i + WIDTH] for i in range(0, max(1, len(text) - WIDTH + STEP), STEP)]


def _grams(text: bytes) -> set[bytes]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


def enriched_strings(toxic: list[bytes], ordinary: list[bytes], size: int = 2048) -> list[bytes]:
    """Word parts that toxic texts hold far more often than ordinary ones, most common first."""
    t, o = Counter(), Counter()
    for text in toxic:
        t.update(_grams(text))
    for text in ordinary:
        o.update(_grams(text))
    nt, no, least = len(toxic), len(ordinary), max(3, 0.01 * len(toxic))
    marked = {g for g, n in t.items() if n >= least and (n + 0.5) * (no + 1) >= ENRICHED * (o[g] + 0.5) * (nt + 1)}
    found: Counter = Counter()
    for text in toxic:
        own, i = set(), 0
        while i <= len(text) - GRAM:
            if text[i : i + GRAM] not in marked:
                i += 1
                continue
            j = i
            while j <= len(text) - GRAM and text[j : j + GRAM] in marked:
                j += 1
            own.update(p for p in text[i : j + GRAM - 1].split() if len(p) >= GRAM - 1)
            i = j
        found.update(own)
    out: list[bytes] = []
    for piece, n in found.most_common():
        if n < least or sum(map(len, out)) > size:
            break
        if not any(piece in x for x in out):
            out.append(piece)
    # inflected forms of one stem stand for it; a stem must be as enriched, and common among toxic texts
    by: dict[bytes, list[bytes]] = {}
    for piece in out:
        by.setdefault(piece[: GRAM - 1], []).append(piece)
    stems = dict.fromkeys(os.path.commonprefix(by[p[: GRAM - 1]]) if len(by[p[: GRAM - 1]]) > 2 else p for p in out)
    count = lambda stem, texts: sum(stem in t for t in texts)
    kept = [(x, count(x, toxic), count(x, ordinary)) for x in stems]
    return [x for x, a, b in kept if a >= max(3, SHARE * nt) and (a + 0.5) * (no + 1) >= ENRICHED * (b + 0.5) * (nt + 1)]


class Scorer:
    def __init__(self, base: bytes, extra: bytes):
        self.base, self.extra = base, extra
        self.weights = np.zeros(0)
        self._pairs = None

    def __getstate__(self):
        return self.__dict__ | {"_pairs": None}

    def _compressors(self):
        import zstandard as z

        if self._pairs is None:
            pairs = []
            for trained, strategy, search in SETTINGS:
                kind = z.DICT_TYPE_FULLDICT if trained else z.DICT_TYPE_RAWCONTENT
                p = z.ZstdCompressionParameters(window_log=15, hash_log=16, chain_log=16, search_log=search, min_match=5, target_length=32, strategy=strategy, write_content_size=False, write_dict_id=False)
                pair = []
                for blob in (self.base, self.base + self.extra):
                    d = z.ZstdCompressionDict(blob, dict_type=kind)
                    d.precompute_compress(compression_params=p)
                    pair.append(z.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False))
                pairs.append(pair)
            self._pairs = pairs
        return self._pairs

    def features(self, text: bytes) -> np.ndarray:
        found = _windows(text)
        out = []
        for ordinary, toxic in self._compressors():
            d = np.fromiter((len(ordinary.compress(w)) - len(toxic.compress(w)) for w in found), np.int64, len(found))
            n, top = len(d), np.sort(d)[: -4 : -1]
            counts = [(d >= k).sum() for k in (2, 3, 4, 5, 6, 8)]
            out += [max(0, top[0]), max(0, top.mean()), max(0.0, d.mean()), *(c / n for c in counts), *(np.sqrt(c) for c in counts)]
        return np.log1p(np.array([*out, np.log1p(len(found))], float))

    def fit(self, x: np.ndarray, labels: np.ndarray, ridge: float = 2.0) -> None:
        """Logistic calibration of features ``x``."""
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-6
        x = np.column_stack([(x - self.mean) / self.spread, np.ones(len(x))])
        w, pull = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, ridge), 1e-3)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
            step = np.linalg.solve(h, x.T @ (labels - p) - pull * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w

    def score(self, text: bytes) -> float:
        if not len(self.weights):
            return 0.0
        x = np.append((self.features(text) - self.mean) / self.spread, 1.0)
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = 4_000, longest: int = 20_000, dictionary: int = 8_192, seed: int = 7) -> Scorer:
    """Scorer from documents and their labels (doc_id, ``label`` 0/1). The sample is bounded: about
    ``rows`` rows of label 1 and twice as many of label 0, by identifier hash, less those of over
    ``longest`` bytes."""
    sample = labelled_sample(docs, labels, label, {0: 2 * rows, 1: rows}).where(F.col("text").isNotNull() & (F.octet_length("text") <= longest))
    sample = sample.select("text", "y", F.xxhash64("doc_id", F.lit(seed)).alias("h")).toPandas().sort_values(["h", "y", "text"])
    if sample["y"].nunique() < 2:
        return Scorer(b"", b"")
    texts, y = [t.encode() for t in sample["text"]], sample["y"].to_numpy(float)
    part = np.arange(len(y)) % 2
    half = [_dictionaries([t for t, p in zip(texts, part, strict=True) if p == k], y[part == k], dictionary, seed) for k in (0, 1)]
    # features of each half come from dictionaries that it made no part of
    x = np.stack([half[1 - p].features(t) for t, p in zip(texts, part, strict=True)])
    scorer = _dictionaries(texts, y, dictionary, seed)
    scorer.fit(x, y)
    return scorer


def _dictionaries(texts: list[bytes], y: np.ndarray, size: int, seed: int) -> Scorer:
    import zstandard as z

    toxic, ordinary = ([t for t, v in zip(texts, y, strict=True) if v == k] for k in (1, 0))
    windows = [w for t in ordinary for w in _windows(t)]
    random.Random(seed).shuffle(windows)
    try:
        base = z.train_dictionary(size, windows[:20_000], k=64, d=8).as_bytes()
    except z.ZstdError:  # too little text to train on
        base = b"".join(windows)[:size] or b"0" * 64
    return Scorer(base, b"".join(b" " + s for s in reversed(enriched_strings(toxic, ordinary))))


def score(df: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, score and predicted for every row."""
    shared = df.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for batch in batches:
            found = [s.score((t.as_py() or "").encode()) for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.float64()), pa.array([int(x >= THRESHOLD) for x in found], pa.int32())], names=["doc_id", "score", "predicted"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, score double, predicted int")
