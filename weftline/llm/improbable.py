"""Fingerprints of improbable features: similarity digests over chained Bloom filters.

Features are the byte windows of ``WINDOW`` bytes. A window's Shannon entropy, kept as exact integers
by what a byte adds on entering and takes on leaving, falls on one of ``LEVELS`` + 1 levels; the levels
are ranked by how few windows of all documents have them (``fit``), the rarest first. Every run of
``RUN`` consecutive features votes for its rarest, the leftmost of equals; features with at least
``VOTES`` votes (or as many as there are runs) are selected. Levels below ``LOW`` are repetitive and
never selected. Selected windows are hashed once a text, in order, into Bloom filters of ``BITS`` bits
at ``HASHES`` bits a feature, and after ``CHAIN`` features the next filter begins.

Likeness of two fingerprints: for each filter of the one with fewer features, the best overlap with
any filter of the other, as (common - chance) / (possible - chance) where it is over chance by three
standard deviations and else 0; the mean by number of features. Equal fingerprints have 1.

The text of a fingerprint is its filters joined by ".", each the number of features (two hex digits)
and the bits in hex. Texts are cut into segments of bounded size that overlap by what a vote can see,
so a long text takes no more memory than its own bytes; documents reach tasks by range of their
identifiers, in a number of ranges that follows the shuffle partitions.

Defined cases: a null text is empty; an empty text has the empty fingerprint, whose likeness is 1 to itself and 0 to any other; a text
that selects nothing (shorter than a window, or of repetitive bytes only) has its whole as its one
feature. A null identifier comes after all others, and rows that share an identifier follow one
another by text (equal rows in any order, which have equal results). An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from .common import documents_only, mix, tidy

WINDOW, RUN, VOTES, LEVELS, LOW = 32, 16, 4, 1000, 100
BITS, HASHES, CHAIN = 2048, 5, 160
SEGMENT, PIECES = 1 << 18, 1 << 12
_ONE = 1 << 20
#: c * log2(c) in units of 2**-20, and what the c-th equal byte of a window adds to the sum of them.
_CLOGC = np.array([0, *[round(c * math.log2(c) * _ONE) for c in range(1, WINDOW + 1)]], np.int64)
_GAIN = np.concatenate([[0], np.diff(_CLOGC)])
_MOST = int(_CLOGC[WINDOW])
_NEVER = LEVELS + 1


def levels(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Entropy level (0 to LEVELS) of the window that starts at each byte; -1 where its text ends before."""
    n = len(data)
    lengths = np.diff(offsets)
    order = np.argsort(data, kind="stable")
    # equal bytes side by side; other bytes and other texts are at least a window apart
    spread = np.arange(n, dtype=np.int32) + np.repeat(np.arange(len(lengths), dtype=np.int32) * WINDOW, lengths)
    at = (spread + data.astype(np.int32) * np.int32(n + (len(lengths) + 1) * WINDOW))[order]
    before, after = np.ones(n, np.uint8), np.ones(n, np.uint8)
    pair = np.arange(n, dtype=np.int32)
    for t in range(1, WINDOW):
        pair = pair[np.searchsorted(pair, t) :]
        pair = pair[at[pair] - at[pair - t] < WINDOW]
        if not len(pair):
            break
        before[pair] += 1
        after[pair - t] += 1
    enter, leave = np.empty(n, np.uint8), np.empty(n, np.uint8)
    enter[order], leave[order] = before, after
    enters, leaves = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    np.cumsum(_GAIN[enter], out=enters[1:])
    np.cumsum(_GAIN[leave], out=leaves[1:])
    out = np.full(n, -1, np.int64)
    if n >= WINDOW:
        begin = np.repeat(offsets[:-1], lengths)[: n - WINDOW + 1]
        total = enters[WINDOW:] - enters[begin] - leaves[: n - WINDOW + 1] + leaves[begin]
        whole = np.arange(WINDOW, n + 1) <= np.repeat(offsets[1:], lengths)[: n - WINDOW + 1]
        out[: n - WINDOW + 1] = np.where(whole, (_MOST - total) * LEVELS // _MOST, -1)
    return out


def votes(level: np.ndarray, ranks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Votes of each feature by all runs of its text (one run where there are fewer features)."""
    n = len(level)
    key = (np.where(level < LOW, _NEVER, ranks[level]) << 40) | np.arange(n)
    best, step = np.concatenate([key, np.full(RUN, _NEVER << 40)]), 1
    while step < RUN:
        best[:-step] = np.minimum(best[:-step], best[step:])
        step *= 2
    lengths = np.diff(offsets)
    features = np.maximum(lengths - WINDOW + 1, 0)
    runs = np.where(features > 0, np.maximum(features - RUN + 1, 1), 0)
    voting = np.arange(n) - np.repeat(offsets[:-1], lengths) < np.repeat(runs, lengths)
    won = best[:n][voting]
    return np.bincount((won & ((1 << 40) - 1))[won >> 40 != _NEVER], minlength=n)


def _segments(lengths: np.ndarray) -> Iterator[list[tuple[int, int, int, int, int]]]:
    """Groups of (text, from, to, first, last): bytes from:to of a text, whose features first:last are settled there."""
    held, size = [], 0
    for i, n in enumerate(lengths.tolist()):
        for first in range(0, max(n, 1), SEGMENT):
            last = min(first + SEGMENT, n)
            piece = (i, max(0, first - RUN + 1), min(n, last + RUN + WINDOW), first, last)
            if held and (size + piece[2] - piece[1] > SEGMENT or len(held) == PIECES):
                yield held
                held, size = [], 0
            held.append(piece)
            size += piece[2] - piece[1]
    if held:
        yield held


def _laid(texts: list[bytes], group: list[tuple[int, int, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(texts[i][a:b] for i, a, b, _, _ in group), np.uint8)
    return data, np.concatenate([[0], np.cumsum([b - a for _, a, b, _, _ in group])]).astype(np.int64)


def _settled(offsets: np.ndarray, group: list[tuple[int, int, int, int, int]]) -> np.ndarray:
    """Which bytes of a group's pieces are settled in it."""
    lengths = np.diff(offsets)
    inside = np.arange(offsets[-1]) - np.repeat(offsets[:-1] + [f - a for _, a, _, f, _ in group], lengths)
    return (inside >= 0) & (inside < np.repeat([e - f for _, _, _, f, e in group], lengths))


def level_counts(texts: list[bytes]) -> np.ndarray:
    """How many windows of the texts have each level."""
    out = np.zeros(LEVELS + 1, np.int64)
    for group in _segments(np.array([len(t) for t in texts], np.int64)):
        data, offsets = _laid(texts, group)
        level = levels(data, offsets)
        out += np.bincount(level[_settled(offsets, group) & (level >= 0)], minlength=LEVELS + 1)
    return out


def ranked(counts: np.ndarray) -> np.ndarray:
    """Rank of each level by its number of windows, the rarest first, the higher entropy of equals first."""
    ranks = np.empty(LEVELS + 1, np.int64)
    ranks[np.lexsort((-np.arange(LEVELS + 1), counts))] = np.arange(LEVELS + 1)
    return ranks


@dataclass
class Print:
    """A fingerprint: filters as rows of 64-bit words, and their numbers of features."""

    bits: np.ndarray
    sizes: np.ndarray

    def __str__(self) -> str:
        return ".".join(f"{n:02x}{row.tobytes().hex()}" for n, row in zip(self.sizes.tolist(), self.bits, strict=True))

    @classmethod
    def parse(cls, text: str) -> Print:
        parts = text.split(".") if text else []
        bits = np.frombuffer(bytes.fromhex("".join(p[2:] for p in parts)), np.uint64).reshape(len(parts), BITS // 64)
        return cls(bits, np.array([int(p[:2], 16) for p in parts], np.int64))


def fingerprint(texts: list[bytes], ranks: np.ndarray) -> list[Print]:
    """Fingerprints of a batch of texts."""
    lengths = np.array([len(t) for t in texts], np.int64)
    need = np.minimum(VOTES, np.maximum(lengths - WINDOW - RUN + 2, 1))
    owner, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for group in _segments(lengths):
        data, offsets = _laid(texts, group)
        of = np.repeat([i for i, *_ in group], np.diff(offsets))
        got = np.flatnonzero((votes(levels(data, offsets), ranks, offsets) >= need[of]) & _settled(offsets, group)) if len(data) >= WINDOW else np.zeros(0, np.int64)
        quads = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[got].view(np.uint64) if len(got) else np.zeros((0, WINDOW // 8), np.uint64)
        hashed = np.full(len(got), WINDOW, np.uint64)
        for c in range(WINDOW // 8):
            hashed = mix(hashed ^ quads[:, c]) + np.uint64(c)
        owner.append(of[got])
        hashes.append(hashed)
    owner, hashes = np.concatenate(owner), np.concatenate(hashes)
    bare = np.setdiff1d(np.flatnonzero(lengths), owner)
    if len(bare):
        owner = np.concatenate([owner, bare])
        hashes = np.concatenate([hashes, np.array([int.from_bytes(hashlib.blake2b(texts[i], digest_size=8).digest(), "little") for i in bare], np.uint64)])
        order = np.argsort(owner, kind="stable")
        owner, hashes = owner[order], hashes[order]
    # a feature counts once a text, at its first place
    order = np.lexsort((np.arange(len(owner)), hashes, owner))
    first = np.ones(len(order), bool)
    first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    kept = np.sort(order[first])
    owner, hashes = owner[kept], hashes[kept]
    many = np.bincount(owner, minlength=len(texts))
    chain = -(-many // CHAIN)
    starts = np.concatenate([[0], np.cumsum(chain)])
    place = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    filters = starts[owner] + place // CHAIN
    bits = np.zeros((int(starts[-1]), BITS), np.uint8)
    width = BITS.bit_length() - 1
    for k in range(HASHES):
        bits[filters, ((hashes >> np.uint64(width * k)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    words = np.packbits(bits, axis=1).view(np.uint64)
    sizes = np.bincount(filters, minlength=int(starts[-1]))
    return [Print(words[starts[i] : starts[i + 1]], sizes[starts[i] : starts[i + 1]]) for i in range(len(texts))]


def likeness(a: Print, b: Print) -> float:
    """Normalised bit overlap of two fingerprints, 0 to 1; symmetric."""
    if not len(a.sizes) or not len(b.sizes):
        return float(len(a.sizes) == len(b.sizes))
    if a.bits.shape == b.bits.shape and (a.bits == b.bits).all():
        return 1.0
    if (a.sizes.sum(), a.bits.tobytes()) > (b.sizes.sum(), b.bits.tobytes()):
        a, b = b, a
    set_a, set_b = np.bitwise_count(a.bits).sum(1, np.int64), np.bitwise_count(b.bits).sum(1, np.int64)
    best, step = np.zeros(len(set_a)), max(1, (1 << 16) // len(set_b))
    for i in range(0, len(set_a), step):
        common = np.bitwise_count(a.bits[i : i + step, None, :] & b.bits[None]).sum(2, np.int64)
        most, full = np.minimum(set_a[i : i + step, None], set_b[None]), np.maximum(set_a[i : i + step, None], set_b[None]) / BITS
        chance = most * full
        score = np.where(common > chance + 3 * np.sqrt(chance * (1 - full)), (common - chance) / (most - chance), 0.0)
        best[i : i + step] = score.max(1)
    return float((best * a.sizes).sum() / a.sizes.sum())


def _encoded(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(LEVELS + 1, np.int64)
    for batch in batches:
        total += level_counts(_encoded(batch.column("text")))
    yield pa.record_batch([pa.array([total], pa.list_(pa.int64()))], names=["counts"])


def fit(docs: DataFrame) -> list[int]:
    """Rank of each level over all windows of all documents; one row of counts a partition is summed."""
    counts = documents_only(docs).select("text").mapInArrow(tidy(_counting), "counts array<long>").select(F.posexplode("counts").alias("level", "n"))
    found = {r["level"]: int(r["n"]) for r in counts.groupBy("level").agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n")).collect()}
    return ranked(np.array([found.get(i, 0) for i in range(LEVELS + 1)], np.int64)).tolist()


def fingerprints(docs: DataFrame, ranks: list[int]) -> DataFrame:
    """doc_id and fingerprint of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(ranks, np.int64)
        for batch in batches:
            prints = fingerprint(_encoded(batch.column("text")), table)
            yield pa.record_batch([batch.column("doc_id"), pa.array(map(str, prints), pa.string())], names=["doc_id", "fingerprint"])

    return documents_only(docs).mapInArrow(tidy(run), "doc_id long, fingerprint string")


def likeness_of(a, b):
    """Likeness of two columns of fingerprints; null with a null."""

    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else likeness(Print.parse(p), Print.parse(q)) for p, q in zip(x, y, strict=True)], dtype="Float64")

    return pandas_udf(of, DoubleType())(a, b)


def _range_of(value, edges: list[int]):
    """Number of edges that are at most ``value``, by binary search."""
    if not edges:
        return F.lit(0)
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(len(edges).bit_length()))])
    table, n = F.lit(edges), F.lit(len(edges))
    return F.aggregate(halves, F.lit(0), lambda at, half: F.when((at + half <= n) & (F.element_at(table, F.least(at + half, n)) <= value), at + half).otherwise(at))


def in_order(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """range, guest, doc_id, text: documents sorted by identifier within ranges, each followed by its
    next. A range ends with a guest row, the first document of the next range (of the first one after the last).

    The edges are quantiles of the identifiers; only the identifiers are read for them. One row a range
    (its least identifier) reaches the driver and is broadcast."""
    rows = documents_only(docs)
    n = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    many = min(ranges or 4 * n, 20_000)  # more ranges than partitions, so that hashing them deals evenly
    cuts = rows.select(F.percentile_approx("doc_id", [k / many for k in range(1, many)], 20 * many).alias("cuts")).first()["cuts"] if many > 1 else []
    number = F.when(F.col("doc_id").isNull(), F.lit(len(set(cuts or [])))).otherwise(_range_of(F.col("doc_id"), sorted(set(cuts or []))))
    rows = rows.select(number.cast("int").alias("range"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    heads = sorted(tuple(r) for r in rows.groupBy("range").agg(F.min("doc_id").alias("head")).collect())
    around = [(r, head, heads[k - 1][0]) for k, (r, head) in enumerate(heads)]
    known = F.broadcast(docs.sparkSession.createDataFrame(around, "range int, head long, before int"))  # at most ``many`` rows
    own, guest = F.struct("range", F.lit(0).alias("guest")), F.struct(F.col("before").alias("range"), F.lit(1).alias("guest"))
    places = F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array(own, guest)).otherwise(F.array(own))
    dealt = rows.join(known, "range").select(F.explode(places).alias("place"), "doc_id", "text").select("place.range", "place.guest", "doc_id", "text")
    return dealt.repartition(n, "range").sortWithinPartitions("range", "guest", F.asc_nulls_last("doc_id"), "text")


def half_replaced(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edited_likeness(docs: DataFrame, ranks: list[int], edit=half_replaced) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every
    document, beside its edit with the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(ranks, np.int64)
        held: list[tuple[int, int, int | None, str]] = []
        last: Print | None = None  # of held[0], where it is left over

        def settled() -> pa.RecordBatch:
            nonlocal held, last
            prints = ([last] if last is not None else []) + fingerprint([r[3].encode() for r in held[last is not None :]], table)
            own = [i for i in range(len(held) - 1) if not held[i][1]]
            texts = [edit(held[i][3], held[i + 1][3]).encode() for i in own]
            edited = fingerprint(texts, table)
            out = {
                "doc_id": pa.array([held[i][2] for i in own], pa.int64()),
                "n_chars": pa.array([len(held[i][3]) for i in own], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                "fingerprint": pa.array([str(prints[i]) for i in own], pa.string()),
                "edited_fingerprint": pa.array(map(str, edited), pa.string()),
                "near_edited": pa.array([likeness(prints[i], e) for i, e in zip(own, edited, strict=True)], pa.float64()),
                "near_next": pa.array([likeness(prints[i], prints[i + 1]) for i in own], pa.float64()),
            }
            held, last = held[-1:], prints[-1]
            return pa.record_batch(list(out.values()), names=list(out))

        size = 0
        for batch in batches:
            columns = [batch.column(c) for c in ("range", "guest", "doc_id", "text")]
            for i in range(batch.num_rows):
                held.append(tuple(c[i].as_py() for c in columns))
                size += len(held[-1][3])
                if size > SEGMENT and len(held) > 1:
                    yield settled()
                    size = len(held[0][3])
        if len(held) > 1:
            yield settled()

    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs).mapInArrow(tidy(run), kinds)
