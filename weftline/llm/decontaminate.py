"""Benchmark decontamination by template canonicalisation.

Tokens are white-space words without leading and trailing ASCII punctuation, ASCII letters
lower-cased. A token holding a digit becomes NUM, a unit word right after one becomes UNIT, a
capitalised word that is not all capitals becomes NAME; every other token stays literal. In scripts
without spaces every character is a token. Windows of ``WINDOW`` tokens (a shorter item is one window)
with enough literals are hashed as templates; the others, and items of one or two tokens, are hashed
as they are, so that verbatim copies are found whatever the number of slots. The benchmark's
hashes go to the executors as sorted arrays, in blocks of a fixed size, so a benchmark of any size
is searched in as many passes; the few document windows that match are joined to the item windows.
Windows with a NAME are searched as they are too, so that a copy in lower case is found. A run of
equal windows without slots is one row with its length, and two runs meet at both their ends only.

Matches are judged on one diagonal (document place less item place) of a document and item at a time: the slot values of the item
must map one to one onto those of the document, so a question asked with other names or numbers is
caught and a chance run of placeholders is not. Where windows contradict one another the mapping takes
the pairs by votes or in reading order, whichever covers more; windows with the item's own slots always count.
What is left of a diagonal are covered intervals and its mapping, so that no step holds more than an item's windows or a pair's diagonals.

A document is reported for an item if one diagonal matches ``RUN`` tokens or ``COVER`` of the item, or else if
diagonals near one another with mappings that agree match ``COVER`` of it together: words put in or taken out, up to half as
many as the item has (or ``WINDOW``), shift the rest of a passage to other diagonals.

Defined cases: null and empty texts on either side match nothing; equal items are each reported. Documents are
told apart by identifier and text, so a null identifier stays null, ``clean`` drops just the rows that match, and rows
that share both are reported once an item. Items without identifier or sharing one count as one. Other columns
are ignored, or kept by ``clean``. An empty table on either side gives no matches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _byte_table, grams, materialise, mix, ranges_hash, slices, tidy, words

WINDOW, LITERALS, COVER, RUN = 8, 4, 0.6, 13
BLOCK = 2_000_000
_SLICE = 1 << 18  # keeps a worker's arrays to a few tens of MB
SMALL = 200_000
NUM, UNIT, NAME = 1, 2, 3
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms oz ounce ounces lb lbs pound pounds ton tons "
    "ml l liter liters litre litres gallon gallons cup cups s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent degree degrees mph kmh km/h meter meters metre metres kilometer kilometers kilometre kilometres centimeters centimetres"
).split()

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_ROW = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("pos", pa.int32()), ("size", pa.int32()), ("reps", pa.int32()), ("hash", pa.int64()), ("slots", pa.list_(pa.int64())), ("tokens", pa.int32()), ("raw", pa.bool_())])


def _hash_words(found: list[str]) -> np.ndarray:
    blob = np.frombuffer(" ".join(found).encode(), np.uint8)
    starts, ends, _ = words(blob, np.array([0, len(blob)]))
    return np.sort(ranges_hash(_byte_table(0)[blob], starts, ends, 0))


_UNITS = _hash_words(UNITS)


def _lone(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of characters of scripts without spaces: Thai to Burmese, Khmer, kana, Han."""
    at = np.flatnonzero((data >= 0xE0) & (data <= 0xE9) | (data == 0xEF) | (data == 0xF0))
    a, b, c = data[at], data[np.minimum(at + 1, len(data) - 1)], data[np.minimum(at + 2, len(data) - 1)]
    han = (a >= 0xE3) & (a <= 0xE9) | (a == 0xEF) & (b >= 0xA4) & (b <= 0xAB)
    thai = (a == 0xE0) & (b >= 0xB8) & (b <= 0xBB) | (a == 0xE1) & ((b == 0x80) | (b == 0x81) | (b == 0x82) & (c < 0xA0) | (b == 0x9E) | (b == 0x9F))
    full = (a == 0xEF) & ((b == 0xBC) | (b == 0xBD))  # full-width marks between them
    wide = (a == 0xF0) & (b >= 0xA0) & (b <= 0xB3)
    keep = han | thai | full | wide
    return at[keep], np.where(wide[keep], 4, 3)


def _split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, cut around each character of a script without spaces; ideographic punctuation is left out."""
    starts, ends, _ = words(data, offsets)
    lone, size = _lone(data)
    if not len(lone) or not len(starts):
        return starts, ends
    end = ends[np.searchsorted(starts, lone, "right") - 1]
    after = lone + size
    new = np.unique(np.concatenate([starts, lone, after[after < end]]))
    end = np.minimum(np.append(new[1:], len(data)), ends[np.searchsorted(starts, new, "right") - 1])
    b, c = data[np.minimum(new + 1, len(data) - 1)], data[np.minimum(new + 2, len(data) - 1)]
    mark = (data[new] == 0xE3) & (b == 0x80) & ((c < 0x85) | (c > 0x87))
    mark |= (data[new] == 0xEF) & (b == 0xBC) & ((c <= 0x8F) | (c >= 0x9A) & (c <= 0xA0) | (c >= 0xBB))
    return new[~mark], end[~mark]


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(literal hash, slot type or 0, first token of each text)."""
    starts, ends = _split(data, offsets)
    first = np.searchsorted(starts, offsets)
    solid = np.flatnonzero(~_PUNCT[data])
    if not len(starts) or not len(solid):
        return np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(len(offsets), np.int64)
    rank = np.concatenate([[0], np.cumsum(~_PUNCT[data])])
    a, b = rank[starts], rank[ends]
    own = np.repeat(np.arange(len(first) - 1), np.diff(first))[b > a]
    a, b = a[b > a], b[b > a]
    starts, ends = solid[a], solid[b - 1] + 1
    hashes = ranges_hash(_byte_table(0)[_LOWER[data]], starts, ends, 0)
    within = lambda mask: (s := np.concatenate([[0], np.cumsum(mask)]))[ends] - s[starts]
    digit = within((data >= 48) & (data <= 57)) > 0
    lead = data[starts]
    second = data[np.minimum(starts + 1, len(data) - 1)]
    upper = (lead >= 65) & (lead <= 90) | (lead == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    wide = np.zeros(len(data), bool)
    wide[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x9F)
    lower = within((data >= 97) & (data <= 122) | wide) > 0
    kind = np.zeros(len(starts), np.int8)
    kind[upper & lower] = NAME
    kind[digit] = NUM
    after = np.flatnonzero(digit[:-1] & (own[1:] == own[:-1])) + 1
    kind[after[np.isin(hashes[after], _UNITS) & ~digit[after]]] = UNIT
    return hashes, kind, np.searchsorted(own, np.arange(len(offsets)))


def _coded(hashes: np.ndarray, kind: np.ndarray) -> np.ndarray:
    return np.where(kind > 0, mix(kind.astype(np.uint64)), hashes)


def _rows(ids: pa.Table, doc: np.ndarray, pos: np.ndarray, at: np.ndarray, size: int, hashed: np.ndarray, hashes: np.ndarray, kind: np.ndarray, fixed: np.ndarray, count: np.ndarray, raw: bool) -> pa.RecordBatch:
    again = np.zeros(len(at), bool)
    again[1:] = (at[1:] == at[:-1] + 1) & (hashed[1:] == hashed[:-1]) & (raw | (fixed[at[1:] + size] == fixed[at[:-1]]))
    head = np.flatnonzero(~again)
    reps = np.diff(np.append(head, len(at)))
    doc, pos, at, hashed = doc[head], pos[head], at[head], hashed[head]
    slots = [[] if raw else hashes[a : a + size][kind[a : a + size] > 0].view(np.int64).tolist() for a in at]
    named = ids.take(pa.array(doc))
    cols = [named.column("id"), named.column("text_hash"), pos.astype(np.int32), np.full(len(at), size, np.int32), reps.astype(np.int32), hashed.view(np.int64), pa.array(slots, pa.list_(pa.int64())), count[doc].astype(np.int32), np.full(len(at), raw)]
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], schema=_ROW)


def windows(ids: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, window: int, literals: int, sizes: list[tuple[int, bool]], wanted=None) -> Iterator[pa.RecordBatch]:
    """All windows of ``sizes`` (tokens, whether hashed as they are); ``window`` for texts that long, else (items only) the whole text.

    Items have each window as it is if it is short of literals, of under three tokens or holds a name, and as a
    template unless it is short. ``wanted`` filters hashes; None keeps them all and takes short texts whole."""
    hashes, kind, first = tokens(data, offsets)
    if not len(hashes):
        return
    code, count = _coded(hashes, kind), np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    fixed, names = (np.concatenate([[0], np.cumsum(x)]) for x in (kind > 0, kind == NAME))
    for size, raw in sizes:
        if size > len(code):
            continue
        h = grams(hashes, size, 1) if raw else grams(code, size)
        at = np.arange(len(h))
        ok = doc[at] == doc[at + size - 1]
        if wanted is None or not raw:
            enough = (size - (fixed[at + size] - fixed[at]) >= min(literals, size - 1)) & (size > 2)
            ok &= ~enough | (names[at + size] > names[at]) if raw else enough
        ok &= wanted(h) if wanted is not None else (size == window) | (count[doc[at]] == size)
        at = np.flatnonzero(ok)
        if size < 3 and len(at):  # the whole of an item: one place in a text is enough
            pairs = np.stack([doc[at].astype(np.uint64), h[at]], 1)
            at = at[np.sort(np.unique(pairs, axis=0, return_index=True)[1])]
        if len(at):
            yield _rows(ids, doc[at], at - first[doc[at]], at, size, h[at], hashes, kind, fixed, count, raw)


class _Wanted:
    """Membership in a sorted array behind a bit table."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.sort(hashes)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.sorted >> np.uint64(42)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = self.bits[h >> np.uint64(42)]
        at = np.flatnonzero(out)
        near = np.searchsorted(self.sorted, h[at])
        out[at] = self.sorted[np.minimum(near, len(self.sorted) - 1)] == h[at]
        return out


_HIT = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("item_id", pa.int64()), ("n_windows", pa.int64()), ("n_tokens", pa.int64()), ("share", pa.float64()), ("exact", pa.bool_())])
_HIT_DDL = "doc_id long, text_hash long, item_id long, n_windows long, n_tokens long, share double, exact boolean"
_DDL = "id long, text_hash long, pos int, size int, reps int, hash long, slots array<long>, tokens int, raw boolean"


def _search(window: int, literals: int, sizes: list[tuple[int, bool]], shared=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if shared is None else shared.value
        for batch in batches:
            ids = batch.select(["id", "text_hash"])
            for lo, hi, data, offsets in slices(batch, "text", _SLICE):
                yield from windows(ids.slice(lo, hi - lo), data, offsets, window, literals, sizes, wanted)

    return run


def _length(spans: list[tuple[int, int]]) -> int:
    """Places that the spans (from, to) cover."""
    return sum(b - a for a, b in _merged(spans))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _mapping(pairs) -> set[tuple[int, int]]:
    """The pairs, taken in order, that map one to one."""
    there, back = {}, {}
    for a, b in pairs:
        if there.get(a, b) == b and back.get(b, a) == a:
            there[a], back[b] = b, a
    return set(there.items())


_LINE = pa.schema([("spans", pa.list_(pa.int32())), ("pairs", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("n_windows", pa.int64()), ("exact", pa.bool_())])
_KEYS = ["doc_id", "text_hash", "item_id", "tokens", "diagonal"]
_LINE_DDL = "doc_id long, text_hash long, item_id long, tokens int, diagonal int, spans array<int>, pairs array<long>, n_tokens long, n_windows long, exact boolean"


def _line(found: list[dict]) -> dict:
    """One diagonal's windows to what counts of them: spans of the item, slot pairs, tokens, windows, whether verbatim."""
    found = sorted(found, key=lambda x: (x["pos"], x["size"], x["slots"], x["d_slots"]))
    own = [set(zip(x["slots"], x["d_slots"], strict=True)) for x in found]
    span = [(x["pos"], x["pos"] + x["reps"] - 1 + x["size"]) for x in found]
    verbatim = [all(a == b for a, b in pairs) for pairs in own]
    votes = Counter(p for pairs in own for p in pairs)
    in_order = list(dict.fromkeys(p for x in found for p in zip(x["slots"], x["d_slots"], strict=True)))
    best: list[int] = []
    for order in (in_order, sorted(in_order, key=lambda p: -votes[p])):
        held = _mapping(order)
        chosen = [i for i in range(len(found)) if verbatim[i] or own[i] <= held]
        if not best or _length([span[i] for i in chosen]) > _length([span[i] for i in best]):
            best = chosen
        if len(best) == len(found):
            break
    spans = _merged([span[i] for i in best])
    pairs = sorted(set().union(*(own[i] for i in best if not verbatim[i])))
    n_windows = len({(found[i]["pos"] + k, found[i]["size"]) for i in best for k in range(found[i]["reps"])})
    return {"spans": [x for s in spans for x in s], "pairs": [x for p in pairs for x in p], "n_tokens": sum(b - a for a, b in spans), "n_windows": n_windows, "exact": all(verbatim[i] for i in best)}


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            judged = pa.RecordBatch.from_pylist([_line(found) for found in part.column("at").to_pylist()], _LINE)
            yield pa.record_batch([*(part.column(c) for c in _KEYS), *judged.columns], names=[*_KEYS, *_LINE.names])


def _together(lines: list[dict], span: int, share: float) -> tuple[int, int, bool] | None:
    """The most tokens that diagonals within ``span`` of one another cover with mappings that agree, if at least ``share``."""
    at = [x["diagonal"] for x in lines]
    spans = [list(zip(x["spans"][::2], x["spans"][1::2], strict=True)) for x in lines]
    pairs = [list(zip(x["pairs"][::2], x["pairs"][1::2], strict=True)) for x in lines]
    stretches, end = [], 0
    for i, low in enumerate(at):
        before, end = end, int(np.searchsorted(at, low + span, "right"))
        if end > max(before, i + 1):  # more than the last stretch held
            n = _length([s for k in range(i, end) for s in spans[k]])
            if n >= share:
                stretches.append((n, i, end))
    best = None
    for n, i, end in sorted(stretches, key=lambda s: (-s[0], s[1])):
        if best is not None and n <= best[0]:
            break
        for order in (sorted(range(i, end), key=lambda k: -lines[k]["n_tokens"]), range(i, end)):
            there, back, chosen = {}, {}, []
            for k in order:
                if all(there.get(a, b) == b and back.get(b, a) == a for a, b in pairs[k]):
                    there.update(pairs[k])
                    back.update((b, a) for a, b in pairs[k])
                    chosen.append(k)
            covered = _length([s for k in chosen for s in spans[k]])
            if covered >= share and (best is None or covered > best[0]):
                best = (covered, sum(lines[k]["n_windows"] for k in chosen), False)
    return best


def _judged(window: int, cover: float, run: int):
    """For each document and item, the diagonal with most tokens if that is a leak, else the diagonals that are one together."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in (r for lo in range(0, batch.num_rows, 256) for r in batch.slice(lo, 256).to_pylist()):
                share = cover * row["tokens"]
                alone = max((x["n_tokens"], x["n_windows"], x["exact"]) for x in row["lines"])
                best = alone if alone[0] >= min(share, run) else _together(sorted(row["lines"], key=lambda x: x["diagonal"]), max(window, row["tokens"] // 2), share)
                if best is not None:
                    out.append({c: row[c] for c in ("doc_id", "text_hash", "item_id")} | {"n_windows": best[1], "n_tokens": best[0], "share": best[0] / row["tokens"], "exact": best[2]})
            yield pa.RecordBatch.from_pylist(out, _HIT)

    return judge


def text_hash(column: str = "text"):
    """What tells texts of one identifier apart."""
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def _found(docs: DataFrame, items: DataFrame, window: int, literals: int, cover: float, run: int, block: int) -> DataFrame:
    spark = docs.sparkSession
    side = items.select(F.col("item_id").cast("long").alias("id"), F.lit(0).cast("long").alias("text_hash"), F.col("text").cast("string").alias("text"))
    sizes = [(n, raw) for n in range(1, window + 1) for raw in (False, True)]
    item_rows = materialise(side.mapInArrow(tidy(_search(window, literals, sizes)), _DDL), "items")
    n_rows = item_rows.count()
    used = sorted((r["size"], r["raw"]) for r in item_rows.select("size", "raw").distinct().collect())  # at most twice ``window`` values
    text = docs.select(F.col("doc_id").cast("long").alias("id"), text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))
    parts = max(1, -(-n_rows // block))
    found = None
    for i in range(parts):  # one pass over the documents for each block of the benchmark
        own = item_rows.where(F.pmod(F.col("hash"), F.lit(parts)) == i).select("hash").distinct().toPandas()["hash"].to_numpy(np.int64).view(np.uint64)
        if len(own):
            shared = spark.sparkContext.broadcast(_Wanted(own))
            one = text.mapInArrow(tidy(_search(window, literals, used, shared)), _DDL)
            found = one if found is None else found.unionByName(one)
    if found is None:
        found = item_rows.limit(0)
    d = found.select(F.col("id").alias("doc_id"), "text_hash", F.col("pos").alias("d_pos"), F.col("reps").alias("d_reps"), "hash", F.col("slots").alias("d_slots"))
    i = item_rows.select(F.col("id").alias("item_id"), "pos", "size", "reps", "hash", "slots", "tokens")
    # checked size; beyond it an ordinary join, whose hot keys adaptive execution splits
    both = d.join(F.broadcast(i) if n_rows <= SMALL else i, "hash")
    # two runs of equal windows meet at their beginnings and at their ends
    both_reps = F.least("reps", "d_reps")
    begin = F.struct((F.col("d_pos") - F.col("pos")).alias("diagonal"), F.col("pos").alias("pos"))
    end = F.struct((F.col("d_pos") + F.col("d_reps") - F.col("pos") - F.col("reps")).alias("diagonal"), (F.col("pos") + F.col("reps") - both_reps).alias("pos"))
    met = both.select("*", both_reps.alias("n"), F.explode(F.when(F.col("reps") == F.col("d_reps"), F.array(begin)).otherwise(F.array(begin, end))).alias("at"))
    window_of = F.struct(F.col("at.pos").alias("pos"), "size", F.col("n").alias("reps"), "slots", "d_slots")
    lines = met.groupBy("doc_id", "text_hash", "item_id", "tokens", F.col("at.diagonal").alias("diagonal")).agg(F.collect_set(window_of).alias("at")).mapInArrow(tidy(_lines), _LINE_DDL)
    group = lines.groupBy("doc_id", "text_hash", "item_id", "tokens").agg(F.collect_list(F.struct("diagonal", "spans", "pairs", "n_tokens", "n_windows", "exact")).alias("lines"))
    return group.mapInArrow(tidy(_judged(window, cover, run)), _HIT_DDL)


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, literals: int = LITERALS, cover: float = COVER, run: int = RUN, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, n_windows, n_tokens, share, exact of contaminated documents.

    ``docs`` has doc_id and text, ``items`` item_id and text."""
    return _found(docs, items, window, literals, cover, run, block).drop("text_hash")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that match no item."""
    leaks = materialise(_found(docs, items, WINDOW, LITERALS, COVER, RUN, BLOCK).select(F.col("doc_id").alias("_leak_id"), F.col("text_hash").alias("_leak_text")).distinct(), "leaks")
    leaks = F.broadcast(leaks) if leaks.count() <= SMALL else leaks  # counted; beyond it both sides are shuffled
    return docs.join(leaks, F.col("doc_id").cast("long").eqNullSafe(F.col("_leak_id")) & (text_hash() == F.col("_leak_text")), "left_anti")
