"""Language identification by interpolated Kneser-Ney character models.

Characters are lower-cased one by one; whatever is no letter or mark becomes one space. Four-grams
are counted over every training text on the executors; the highest order's counts are all that
Kneser-Ney needs, since lower orders use the number of distinct left neighbours. The driver gets one
row per (language, four-gram), all of them, language by language. Models live in arrays
sorted by hash with a bucket index. A text goes to the language of the lowest cross-entropy per
character; it is rejected if that entropy lies beyond what training texts of its length show.

Defined cases: a text that is null or has no letter (digits, symbols, emoji and marks are none) gets ``und`` and score 0 and is rejected; ties go
to the language first in alphabetical order; with no training rows every text is ``und``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix, slices, tidy

ORDER = 4
PAD = ORDER - 1
UNKNOWN = "und"
#: private-use symbols from here on: so many for letters beyond 16 bits, then so many for marks
_ASTRAL, _ASTRAL_LETTERS, _ASTRAL_MARKS = 0xE000, 0x1800, 0x100
_LOW48 = np.uint64((1 << 48) - 1)
_SLICE = 1 << 18  # keeps a worker's arrays to a few tens of MB


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """Code point (16 bits) to symbol: lower case for letters and marks, else a space."""
    out = np.full(1 << 16, 32, np.uint16)
    for i in range(1 << 16):
        c = chr(i)
        if unicodedata.category(c)[0] in "LM":
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else i
    return out


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which symbols are letters; marks and spaces are not."""
    out = np.array([unicodedata.category(chr(i))[0] == "L" for i in range(1 << 16)])
    out[_ASTRAL : _ASTRAL + _ASTRAL_LETTERS] = True
    return out


def _astral(points: np.ndarray) -> np.ndarray:
    """Symbols of code points beyond 16 bits: letters and marks fold into private-use symbols, which no
    other text has, all else is a space."""
    few, inverse = np.unique(points, return_inverse=True)
    out = np.full(len(few), 32, np.uint16)
    for i, p in enumerate(few.tolist()):
        category = unicodedata.category(chr(p))[0]
        if category == "L":
            low = chr(p).lower()
            out[i] = _ASTRAL + (ord(low) if len(low) == 1 else p) % _ASTRAL_LETTERS
        elif category == "M":
            out[i] = _ASTRAL + _ASTRAL_LETTERS + p % _ASTRAL_MARKS
    return out[inverse]


def _symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols with PAD spaces before each text, begin, end of each text's own symbols)."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    at = heads[offsets]
    if len(points) != heads[-1]:  # not valid UTF-8: text by text
        parts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
    sym = _fold()[np.minimum(points, 0xFFFF)]
    astral = points > 0xFFFF
    if astral.any():
        sym[astral] = _astral(points[astral])
    blank = sym == 32
    after = np.ones(len(sym), bool)
    after[1:] = blank[:-1]
    after[at[:-1][at[:-1] < len(sym)]] = True
    keep = ~(blank & after)
    count = np.concatenate([[0], np.cumsum(keep)])
    begin, end = count[at[:-1]], count[at[1:]]
    sym = np.insert(sym[keep], np.repeat(begin, PAD), 32)
    shift = PAD * np.arange(1, len(begin) + 1)
    return sym, begin + shift, end + shift


def _keys(sym: np.ndarray) -> np.ndarray:
    """Four-gram ending at each symbol from the PAD-th on, 16 bits a symbol."""
    s = sym.astype(np.uint64)
    return s[:-3] << np.uint64(48) | s[1:-2] << np.uint64(32) | s[2:-1] << np.uint64(16) | s[3:]


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(n, first)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[list, list]] = {}
    for batch in batches:
        langs = np.asarray(batch.column("lang").to_pylist(), object)
        for lo, hi, data, offsets in slices(batch, "text", _SLICE):
            sym, begin, end = _symbols(data, offsets)
            if len(sym) <= PAD:
                continue
            keys = _keys(sym)
            label = langs[lo:hi]
            own = np.zeros(len(keys) + 1, np.int32)
            names = sorted(set(label))
            code = np.searchsorted(names, label) + 1
            np.add.at(own, begin - PAD, code)
            np.add.at(own, end - PAD, -code)
            own = np.cumsum(own)[:-1]
            for i, name in enumerate(names, 1):
                k, n = np.unique(keys[own == i], return_counts=True)
                ks, ns = held.setdefault(name, ([], []))
                ks.append(k)
                ns.append(n)
                if len(ks) > 15:
                    k, n = _merge(ks, ns)
                    held[name] = ([k], [n])
    for name, (ks, ns) in held.items():
        k, n = _merge(ks, ns)
        for lo in range(0, len(k), 65536):
            part = k[lo : lo + 65536].view(np.int64)
            yield pa.record_batch([pa.array([name] * len(part), pa.string()), pa.array(part), pa.array(n[lo : lo + 65536].astype(np.int64))], names=["lang", "gram", "n"])


class _Sorted:
    """Values by key in arrays sorted by hash; a bucket index on the leading bits starts each search."""

    def __init__(self, keys: np.ndarray):
        hashes = mix(keys)
        self.order = np.argsort(hashes)
        self.hashes = np.append(hashes[self.order], np.uint64(0))
        self.bits = max(1, int(np.ceil(np.log2(max(2, 2 * len(keys))))))
        self.first = np.searchsorted(self.hashes[:-1] >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place in hash order, or -1."""
        h = mix(keys)
        b = (h >> np.uint64(64 - self.bits)).astype(np.int32)
        at, end = self.first[b], self.first[b + 1]
        hit = (self.hashes[at] == h) & (at < end)
        out = np.where(hit, at, -1)
        rest = np.flatnonzero(~hit & (at + 1 < end))
        step = 1
        while len(rest):
            a = at[rest] + step
            good = self.hashes[a] == h[rest]
            out[rest[good]] = a[good]
            rest = rest[~good & (a + 1 < end[rest])]
            step += 1
        return out


def _types(keys: np.ndarray, counts: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of the low ``bits`` of sorted-unique keys and the sum of counts (or number of types)."""
    low, inverse = np.unique(keys & np.uint64((1 << bits) - 1), return_inverse=True)
    return low, np.bincount(inverse, counts, len(low)) if counts is not None else np.bincount(inverse, minlength=len(low))


class KneserNey:
    """Interpolated Kneser-Ney of one language over symbols packed 16 bits each."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.levels = []
        keys, n = grams, counts.astype(float)
        for order in range(ORDER, 0, -1):
            context = keys >> np.uint64(16)
            heads, inverse = np.unique(context, return_inverse=True)
            once, twice = int((n == 1).sum()), int((n == 2).sum())
            d = once / (once + 2 * twice) if once and twice else 0.5
            total, kinds = np.bincount(inverse, n), np.bincount(inverse)
            table, top = _Sorted(keys), _Sorted(heads)
            self.levels.append((table, (np.maximum(n - d, 0) / total[inverse])[table.order], top, (d * kinds / total)[top.order]))
            if order > 1:
                keys, n = _types(keys, None, 16 * (order - 1))
                n = n.astype(float)
        self.alphabet = len(keys) + 1

    def logp(self, keys: np.ndarray) -> np.ndarray:
        p, weight = np.zeros(len(keys)), np.ones(len(keys))
        for i, (table, value, top, back) in enumerate(self.levels):
            k = keys & np.uint64((1 << 16 * (ORDER - i)) - 1)
            at, ctx = table.find(k), top.find(k >> np.uint64(16))
            p += np.where(at >= 0, weight * value[at], 0)
            weight = weight * np.where(ctx >= 0, back[ctx], 1)
        return np.log(p + weight / self.alphabet)


class Model:
    """All languages; ``limits`` holds (mean, spread at any length, spread of one character) of each."""

    def __init__(self, grams: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(grams)
        self.parts, every = [], [np.zeros(0, np.uint64)]
        for lang in self.langs:
            keys, n = grams[lang][0].astype(np.int64).view(np.uint64), grams[lang][1]
            order = np.argsort(keys)
            self.parts.append(KneserNey(keys[order], n[order]))
            every.append(keys)
        union = np.unique(np.concatenate(every))
        self.table = _Sorted(union)
        self.rows = np.stack([p.logp(union)[self.table.order] for p in self.parts], 1).astype(np.float32) if self.parts else np.zeros((0, 0), np.float32)
        self.limits: dict[str, tuple[float, float, float]] = {}

    def entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages cross-entropies in nats a character, number of characters; 0: no letter)."""
        sym, begin, end = _symbols(data, offsets)
        size = end - begin
        letters = np.concatenate([[0], np.cumsum(_letters()[sym])])
        size = np.where(letters[end] > letters[begin], size, 0)
        out = np.zeros((len(size), len(self.langs)))
        if not size.any() or not self.langs:
            return out, size
        keys = _keys(sym)
        at = self.table.find(keys)
        logs = self.rows[at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            few, inverse = np.unique(keys[miss], return_inverse=True)
            logs[miss] = np.stack([p.logp(few) for p in self.parts], 1).astype(np.float32)[inverse]
        some = np.flatnonzero(size)
        edges = np.stack([begin[some] - PAD, end[some] - PAD], 1).ravel()
        padded = np.concatenate([logs, np.zeros((1, logs.shape[1]), np.float32)])
        for j in range(len(self.langs)):
            out[some, j] = -np.add.reduceat(padded[:, j].astype(float), edges)[::2] / size[some]
        return out, size


TEMPERATURE = 12.0
#: A text is never rejected within so many nats of its language's mean: training texts look better than others under a small model.
MARGIN = 1.5


def _predict(model: Model, z: float, with_entropy: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for lo, hi, data, offsets in slices(batch, "text", _SLICE):
                h, n = m.entropies(data, offsets)
                if m.langs:
                    best = h.argmin(1)
                    low = h[np.arange(len(h)), best]
                    score = 1 / np.exp(-TEMPERATURE * (h - low[:, None])).sum(1)
                    limits = np.array([m.limits.get(x, (np.inf, 0, 0)) for x in m.langs])[best]
                    rejected = (n == 0) | (low > limits[:, 0] + np.maximum(MARGIN, z * (limits[:, 1] + limits[:, 2] / np.sqrt(np.maximum(n, 1)))))
                    langs = np.where(n == 0, UNKNOWN, np.asarray(m.langs, object)[best])
                else:
                    low, score, rejected, langs = np.zeros(len(n)), np.zeros(len(n)), np.ones(len(n), bool), np.full(len(n), UNKNOWN, object)
                ids = batch.column("doc_id").slice(lo, hi - lo)
                cols = [ids, pa.array(langs, pa.string()), pa.array(np.where(n == 0, 0.0, score)), pa.array(rejected), pa.array(low), pa.array(n.astype(np.int64))]
                yield pa.record_batch(cols, names=["doc_id", "lang_pred", "score", "rejected", "entropy", "n_symbols"])

    return run


_OUT = "doc_id long, lang_pred string, score double, rejected boolean, entropy double, n_symbols long"


def fold_of(doc_id: Column, modulus: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def _grams(counts: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Four-grams and counts of each language, numbers only and a language at a time."""
    out = {}
    for row in counts.select("lang").distinct().sort("lang").collect():
        own = counts.where(F.col("lang") == row["lang"]).select("gram", "n").toArrow()
        out[row["lang"]] = tuple(own.column(c).to_numpy() for c in ("gram", "n"))
    return out


_UNIT = 1 << 20  # limits are sums of whole numbers of this part of a nat, the same in any order


def _limits(seen: DataFrame) -> dict[str, tuple[float, float, float]]:
    """(mean, spread at any length, spread of one character) of each language, from lang_pred, entropy and n_symbols of all
    its training texts. Spread at any length is that of the texts at least as long as the median one."""
    whole = lambda x: F.round(x * _UNIT).cast("decimal(38,0)")
    h, n = F.col("entropy"), F.col("n_symbols")
    ways = [(F.sum(whole(h * n)).cast("double") / F.sum(n) / _UNIT).alias("mean"), F.percentile(n, F.lit(0.5)).alias("middle")]
    mean = seen.groupBy("lang_pred").agg(*ways)
    around, long = seen.join(F.broadcast(mean), "lang_pred"), n >= F.col("middle")
    off, pick = h - F.col("mean"), lambda x: F.sum(F.when(long, whole(x)))
    sums = around.groupBy("lang_pred", "mean").agg(pick(off).alias("s"), pick(off * off).alias("q"), F.count_if(long).alias("k"), F.avg(whole(off * off * n)).alias("v"))
    out = {}
    for r in sums.collect():
        s, q, v = (float(r[c]) / _UNIT for c in "sqv")
        spread = np.sqrt(max(0.0, q / r["k"] - (s / r["k"]) ** 2))
        out[r["lang_pred"]] = (r["mean"], float(max(0.02, spread)), float(max(0.5, np.sqrt(v))))
    return out


def fit(train: DataFrame) -> Model:
    """Model from columns doc_id, text, lang. All rows are counted, and the rejection limits are those of all rows."""
    rows = train.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = rows.select("text", "lang").mapInArrow(tidy(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = counts.persist()
    model = Model(_grams(counts))
    counts.unpersist()
    if model.langs:
        judged = rows.select("doc_id", "text").mapInArrow(tidy(_predict(train.sparkSession.sparkContext.broadcast(model), 0.0, True)), _OUT)
        model.limits = _limits(materialise(judged.where("n_symbols > 0").select("lang_pred", "entropy", "n_symbols"), "entropies"))
    return model


def predict(df: DataFrame, model: Model, z: float = 8.0) -> DataFrame:
    """doc_id, lang_pred, score, rejected, entropy, n_symbols for each row."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(_predict(shared, z, True)), _OUT)


def accepted(df: DataFrame, model: Model, z: float = 8.0) -> DataFrame:
    """The rows of ``df`` (all columns) whose text is not rejected; one pass, nothing is joined."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    judge = _predict(shared, z, True)
    text_at = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = pa.record_batch([pa.array(np.arange(batch.num_rows)), batch.column(text_at)], names=["doc_id", "text"])
            keep = pa.concat_arrays([pa.compute.invert(b.column("rejected")) for b in judge(iter([plain]))] or [pa.array([], pa.bool_())])
            yield batch.filter(keep)

    return df.mapInArrow(tidy(run), df.schema)
