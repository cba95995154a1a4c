"""Product codes of integer vectors, assigned by Exponion search.

A vector's components become floor(4096 * x); its ``parts`` equal consecutive parts are coded by the
index of the nearest of at most ``entries`` codebook entries. Codebooks start as the vectors of the
least identifiers and are moved ``rounds`` times to the floored means of their parts.

Each assignment starts at the part's previous entry a (distance d to it, squared distances
throughout) and walks the other entries in order of their distance D from a. An entry at least as
near as a lies within twice the distance, so D <= 4 d; the walk ends beyond that radius. All
distances are exact integers and equal ones go to the lower index, so that the result is that of a
full search.

A round is one pass: mapInArrow assigns the batch, and every partition ends with one row of sums and
counts by part and entry, so that only ``entries * (dimension + parts)`` numbers a partition are
shuffled and as many reach the driver. Vectors travel between rounds as Parquet in the shared folder
with their codes beside them (narrow integers in a binary column); a round deletes nothing that it
reads, and the table before it goes when it has ended.

Defined cases: rows whose vector is null, empty, or holds null or non-finite components are dropped.
The dimension is that of the valid vector of the least identifier (the smaller of several); vectors of another dimension are
dropped too, and there is no result if it is no multiple of ``parts``. Null identifiers come after
all others; of the rows that share an identifier the least vector is the entry, and each row is coded. Fewer than
``entries`` identifiers make smaller codebooks. Components from 2**27 in magnitude after scaling on
(fewer for dimensions over 256), whose summed squares could leave 64 bits, raise ``ValueError``. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, remove, scratch, tidy

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Labels up to this number are broadcast with their totals; more are joined over salted shuffles.
LABELS = 100_000
SALTS = 32
_NAMES = ["vec_id", "label", "vector", "codes", "sums"]


def valid(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label and vector of the rows that are kept, of any dimension."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)


def first_vectors(rows: DataFrame, entries: int) -> list[list[float]]:
    """Vectors of the ``entries`` least identifiers, ascending.

    Each pass takes the least rows of every partition, without a shuffle, and skips past the
    identifiers found; one pass is enough unless identifiers repeat."""
    dimension, ids, more = None, [], rows
    while len(ids) < entries:
        got = more.select("vec_id", F.size("vector").alias("d")).orderBy(F.asc_nulls_last("vec_id"), "d").limit(entries - len(ids)).collect()
        if not got:
            break
        if dimension is None:
            dimension = got[0]["d"]
            rows = rows.where(F.size("vector") == dimension)
            more, got = rows, rows.select("vec_id").orderBy(F.asc_nulls_last("vec_id")).limit(entries).collect()
        ids = list(dict.fromkeys(ids + [r["vec_id"] for r in got]))
        if ids[-1] is None:
            break
        more = rows.where(F.col("vec_id").isNull() | (F.col("vec_id") > ids[-1]))
    if not ids:
        return []
    wanted = F.col("vec_id").isin([i for i in ids if i is not None])
    named = rows.where(F.coalesce(wanted, F.lit(False)) | (F.col("vec_id").isNull() if None in ids else F.lit(False)))
    found = {r["vec_id"]: list(r["v"]) for r in named.groupBy("vec_id").agg(F.min("vector").alias("v")).collect()}
    return [found[i] for i in ids]


def bound(dimension: int) -> int:
    """Magnitude that keeps four times the summed squared differences within 63 bits."""
    return min(1 << 27, int((2**59 / dimension) ** 0.5))


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(4096 * x) of finite doubles as 64-bit integers."""
    out = np.floor(x * SCALE)
    if out.size and float(np.abs(out).max()) >= bound(x.shape[1]):
        raise ValueError(f"vector components must stay below {bound(x.shape[1]) / SCALE:g} in magnitude")
    return out.astype(np.int64)


def _packed(x: np.ndarray) -> list[bytes]:
    """Each row's bytes in the narrowest of 16 and 32 bits that fits the batch."""
    narrow = x.astype(np.int16) if not x.size or np.abs(x).max() < 1 << 15 else x.astype(np.int32)
    return [r.tobytes() for r in narrow]


def _unpacked(column: pa.Array, dimension: int) -> np.ndarray:
    """Rows of 16-bit or 32-bit integers, told apart by their length."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    sizes, starts = np.diff(offsets), offsets[:-1] - offsets[0]
    out = np.empty((len(column), dimension), np.int64)
    for width, kind in ((2, np.int16), (4, np.int32)):
        rows = np.flatnonzero(sizes == width * dimension)
        if len(rows) == len(column):
            return data.view(kind).reshape(-1, dimension).astype(np.int64)
        for r in rows:
            out[r] = data[starts[r] : starts[r] + width * dimension].view(kind)
    return out


class Entries:
    """One part's codebook with, for every entry, the others by ascending distance."""

    def __init__(self, entries: np.ndarray):
        self.entries, n = entries, len(entries)
        gaps = entries[:, None, :] - entries[None, :, :]
        far = (gaps * gaps).sum(2)
        order = np.argsort(far, axis=1, kind="stable")
        self.others = np.array([[j for j in row if j != i] for i, row in enumerate(order)], np.int64).reshape(n, n - 1)
        self.reach = np.take_along_axis(far, self.others, 1)

    def nearest(self, x: np.ndarray, previous: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) for each row, searched from its previous entry."""
        entry = previous.astype(np.int64)
        start = x - self.entries[entry]
        least = np.einsum("ij,ij->i", start, start)
        radius = 4 * least
        by_entry = np.argsort(entry, kind="stable")
        ends = np.searchsorted(entry[by_entry], np.arange(len(self.entries) + 1))
        for a in range(len(self.entries)):
            rows = by_entry[ends[a] : ends[a + 1]]
            if not len(rows) or not self.reach.shape[1]:
                continue
            rows = rows[np.argsort(-radius[rows], kind="stable")]  # the widest radius first: those in reach are a prefix
            near, r, best, arg = x[rows], -radius[rows], least[rows], np.full(len(rows), a)
            for j, reach in zip(self.others[a], self.reach[a], strict=True):
                m = int(np.searchsorted(r, -reach, "right"))
                if not m:
                    break
                gap = near[:m] - self.entries[j]
                d = np.einsum("ij,ij->i", gap, gap)
                better = (d < best[:m]) | ((d == best[:m]) & (j < arg[:m]))
                best[:m][better] = d[better]
                arg[:m][better] = j
            least[rows], entry[rows] = best, arg
        return entry, least


def assign(x: np.ndarray, books: list[Entries], previous: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, summed squared distances) of a batch of integer vectors."""
    width = x.shape[1] // len(books)
    codes, error = np.empty((len(x), len(books)), np.uint8), np.zeros(len(x), np.int64)
    for p, book in enumerate(books):
        code, least = book.nearest(np.ascontiguousarray(x[:, p * width : (p + 1) * width]), previous[:, p])
        codes[:, p] = code
        error += least
    return codes, error


def _prepared(dimension: int, parts: int):
    """Valid vectors to packed integers; the previous entry of the first round is the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
                x = scaled(flat.reshape(n, dimension))
                yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array(_packed(x), pa.binary()), pa.array([bytes(parts)] * n, pa.binary()), pa.nulls(n, pa.list_(pa.int64()))], names=_NAMES)

    return run


def _round(codebooks: np.ndarray):
    """One assignment, and the sums of components and the counts by part and entry in a last row."""
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Entries(b) for b in codebooks]
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _unpacked(batch.column("vector"), parts * width)
            previous = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(n, parts)
            codes, _ = assign(x, books, previous)
            for p in range(parts):
                order = np.argsort(codes[:, p], kind="stable")
                used, first, many = np.unique(codes[order, p], return_index=True, return_counts=True)
                sums[p, used] += np.add.reduceat(x[order, p * width : (p + 1) * width], first, axis=0)
                counts[p, used] += many
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), batch.column("vector"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.nulls(n, pa.list_(pa.int64()))], names=_NAMES)
        if counts.any():
            nothing = [pa.nulls(1, batch.column(c).type) for c in ("vec_id", "label", "vector", "codes")]
            yield pa.record_batch([*nothing, pa.array([np.concatenate([sums.ravel(), counts.ravel()])], pa.list_(pa.int64()))], names=_NAMES)

    return run


def _last(codebooks: np.ndarray):
    parts, _, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Entries(b) for b in codebooks]
        for batch in batches:
            n = batch.num_rows
            if n:
                previous = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(n, parts)
                codes, error = assign(_unpacked(batch.column("vector"), parts * width), books, previous)
                yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def moved(codebooks: np.ndarray, totals: dict[int, int]) -> np.ndarray:
    """Entries at the floored means of their parts; unused ones stay."""
    parts, entries, width = codebooks.shape
    out = codebooks.copy()
    for p in range(parts):
        for e in range(entries):
            count = totals.get(codebooks.size + p * entries + e, 0)
            if count:
                out[p, e] = [totals[(p * entries + e) * width + k] // count for k in range(width)]
    return out


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def train(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, **columns: str) -> tuple[np.ndarray, DataFrame | None, str | None]:
    """(codebooks, rows with their latest codes, folder of those rows); no rows where there is no codebook."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    rows = valid(df, **columns)
    first = first_vectors(rows, entries)
    if not first or len(first[0]) % parts:
        return np.zeros((parts, 0, 0), np.int64), None, None
    spark, dimension = df.sparkSession, len(first[0])
    kind = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, vector binary, codes binary, sums array<long>"
    width = dimension // parts
    codebooks = np.ascontiguousarray(scaled(np.array(first, np.float64)).reshape(len(first), parts, width).transpose(1, 0, 2))
    table = rows.where(F.size("vector") == dimension).mapInArrow(tidy(_prepared(dimension, parts)), kind)
    at = None
    for k in range(rounds):
        now = scratch(spark, f"codes-{k}")
        table.mapInArrow(tidy(_round(codebooks)), kind).write.parquet(now)
        written = spark.read.schema(kind).parquet(now)
        sums = written.where("sums is not null").select(F.posexplode("sums").alias("at", "value"))
        totals = sums.groupBy("at").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("total")).collect()
        codebooks = moved(codebooks, {r["at"]: int(r["total"]) for r in totals})
        table = written.where("vector is not null")
        remove(spark, at)
        at = now
    return codebooks, table, at


def encode(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, **columns: str) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row."""
    spark = df.sparkSession
    codebooks, table, at = train(df, parts, entries, rounds, **columns)
    if table is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = materialise(table.mapInArrow(tidy(_last(codebooks)), f"vec_id long, label {table.schema['label'].dataType.simpleString()}, code string, error long"), "coded")
    remove(spark, at)
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    same = F.col("coded.label").eqNullSafe(F.col("totals.label"))
    if coded.select("label").distinct().limit(LABELS + 1).count() <= LABELS:
        joined = coded.alias("coded").join(F.broadcast(totals).alias("totals"), same)
    else:  # a label may hold any share of the rows, so that each is dealt over SALTS keys
        salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
        every = totals.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = salted.alias("coded").join(every.alias("totals"), same & (F.col("coded.salt") == F.col("totals.salt")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, width: int = 8, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL of ``encode`` by full search over ``embeddings`` of ``parts * width`` components."""
    steps = []
    for k in range(rounds + 1):
        steps.append(
            f"a{k} AS (SELECT row, part, arg_min(entry, d * {entries} + entry) AS entry, min(d) AS d FROM (SELECT v.row, v.part, entry, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{k} c USING (part, pos) GROUP BY ALL) GROUP BY ALL)"
        )
        if k < rounds:
            steps.append(
                f"c{k + 1} AS (SELECT c.part, c.entry, c.pos, CASE WHEN n > 0 THEN (s - ((s % n) + n) % n) // n ELSE c.x END AS x FROM c{k} c LEFT JOIN (SELECT a.part, a.entry, v.pos, sum(v.x) AS s, count(*) AS n FROM a{k} a JOIN v USING (row, part) GROUP BY ALL) m USING (part, entry, pos))"
            )
    return f"""
WITH kept AS (SELECT row_number() OVER () AS row, vec_id, label, embedding FROM embeddings
              WHERE len(embedding) = {parts * width} AND len(list_filter(embedding, lambda x: isfinite(x))) = {parts * width}),
v AS MATERIALIZED (SELECT row, vec_id, i // {width} AS part, i % {width} AS pos, CAST(floor({SCALE}::DOUBLE * embedding[i + 1]) AS BIGINT) AS x FROM kept, range({parts * width}) r(i)),
c0 AS (SELECT part, e.entry, pos, x FROM v JOIN (SELECT row, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {entries}) e USING (row)),
{", ".join(steps).replace("), ", "), " + chr(10))},
books AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, pos)) AS h FROM c{rounds}),
coded AS (SELECT row, string_agg(printf('%02x', CAST(entry AS BIGINT)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY row)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded JOIN kept USING (row), books
    """
