"""Which snippets mention which files, and the line table that follows.

A join by containment: every text is read once for each power of two among the patterns' lengths instead of once a
pattern, by hashes of its windows as long as that; where a pattern may begin, whole lengths are tried. What has the hash of a pattern
leaves the scan as text and is joined with the patterns as such, so the result is exact. Only hashes travel, in blocks of bounded size, as many
passes as there are blocks; no pair that does not match is ever formed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import predicates as pred
from ..functions.base import let
from .cluster import stored

BLOCK = 4_000_000  # 32 bytes of a task each
CHUNK = 1 << 20  # bytes of texts at a time
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SPACE = r"[ \t\r\n\f\x0B]+"


def _chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of some rows at a time; null texts are empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, "right")) - 1)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


_POWERS: list[np.ndarray] = []


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of bytes by powers of an odd number modulo 2^64, and the powers of its inverse: a window's hash is a difference of two sums."""
    n = len(data) + 1
    if not _POWERS or len(_POWERS[0]) < n:
        most = max(n, CHUNK + 1) - 1
        _POWERS[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(most, x), dtype=np.uint64)]) for x in (BASE, INVERSE)]
    powers, back = (x[:n] for x in _POWERS)
    return np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64)]), back


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, data, offsets in _chunks(batch.column("pattern")):
            sums, back = _sums(data)
            size = np.diff(offsets)
            head = _head(size)
            h, first = ((sums[offsets[:-1] + n] - sums[offsets[:-1]]) * back[offsets[:-1]] for n in (size, head))
            yield pa.record_batch([pa.array(size), pa.array(head), pa.array(h.view(np.int64)), pa.array(first.view(np.int64))], names=["size", "head", "hash", "first"])


def _head(size: np.ndarray) -> np.ndarray:
    """Greatest power of two that is at most each size."""
    return np.int64(1) << (np.frexp(size.astype(float))[1].astype(np.int64) - 1)


def _grouped(table: pa.Table) -> dict:
    """head: hashes of the first so many bytes, and by size the hashes of whole patterns; all sorted."""
    size, head, whole, first = (table.column(c).to_numpy() for c in ("size", "head", "hash", "first"))
    whole, first = whole.view(np.uint64), first.view(np.uint64)
    return {int(n): (np.unique(first[head == n]), {int(s): np.unique(whole[size == s]) for s in np.unique(size[head == n])}) for n in np.unique(head)}


def _among(hashes: np.ndarray, h: np.ndarray) -> np.ndarray:
    return hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h


def _scan(shared, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {}
        for head, (first, sizes) in shared.value.items():
            room = max(10, int(len(first) * 16).bit_length())
            seen = np.zeros(1 << room, bool)
            seen[(first * MIX) >> np.uint64(64 - room)] = True
            tables[head] = (first, sizes, seen, np.uint64(64 - room))
        for batch in batches:
            for lo, data, offsets in _chunks(batch.column("text")):
                sums, back = _sums(data)
                rows, patterns = [], []
                for head, (first, sizes, seen, shift) in tables.items():
                    h = (sums[head:] - sums[: max(0, len(sums) - head)]) * back[: max(0, len(back) - head)]
                    at = np.flatnonzero(seen[(h * MIX) >> shift])
                    at = at[_among(first, h[at])]
                    own = np.searchsorted(offsets, at, "right") - 1
                    end = offsets[own + 1]
                    for size, hashes in sizes.items():
                        fit = np.flatnonzero(at + size <= end)
                        start = at[fit]
                        whole = (sums[start + size] - sums[start]) * back[start]
                        hit = np.flatnonzero(_among(hashes, whole))
                        row, text = _once(own[fit[hit]], whole[hit], data[start[hit][:, None] + np.arange(size)])
                        rows.append(lo + row)
                        patterns.append(text)
                row = pa.array(np.concatenate([*rows, np.zeros(0, np.int64)]))
                yield pa.record_batch([*[batch.column(c).take(row) for c in kept], pa.concat_arrays([*patterns, pa.array([], pa.string())])], names=[*kept, "pattern"])

    return run


def _once(row: np.ndarray, h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Each text (one a line of bytes, with its hash) once a row."""
    order = np.lexsort((h, row))
    row, h, text = row[order], h[order], text[order]
    again = (row[1:] == row[:-1]) & (h[1:] == h[:-1])
    if (text[1:][again] != text[:-1][again]).any():  # one hash of two texts
        keep = sorted({(r, t.tobytes()): i for i, (r, t) in enumerate(zip(row.tolist(), text, strict=True))}.values())
    else:
        keep = np.concatenate([np.ones(min(1, len(row)), bool), ~again])
    row, text = row[keep], np.ascontiguousarray(text[keep])
    ends = pa.py_buffer((np.arange(len(row) + 1) * text.shape[1]).astype(np.int32))
    return row, pa.Array.from_buffers(pa.string(), len(row), [None, ends, pa.py_buffer(text)])


def containing(texts: DataFrame, patterns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, pattern): each pattern that each text contains, once. texts: text, and id or whatever else is to come out for it; patterns: pattern.

    A null text contains nothing, the empty pattern is in every other; null patterns are ignored. ``block`` bounds the
    patterns whose hashes a task holds."""
    own = stored(patterns.select("pattern").where("pattern is not null").distinct())
    return _matches(texts, own, block).join(own, "pattern", "left_semi").select(*[c for c in texts.columns if c != "text"], "pattern")


def _matches(texts: DataFrame, own: DataFrame, block: int) -> DataFrame:
    """``containing`` by hashes only: a join with the patterns has yet to leave out what no pattern equals."""
    n = own.where("pattern <> ''").count()
    some = texts.where("text is not null")
    kept = [c for c in texts.columns if c != "text"]
    out = some.join(own.where("pattern = ''").limit(1), how="cross").select(*kept, "pattern")  # at most one row
    parts = -(-n // block)
    for i in range(parts):
        mine = own.where((F.col("pattern") != "") & (F.pmod(F.xxhash64("pattern"), F.lit(parts)) == i)).mapInArrow(_hashed, "size long, head long, hash long, first long")
        shared = texts.sparkSession.sparkContext.broadcast(_grouped(mine.distinct().toArrow()))  # about ``block`` rows of numbers
        out = out.unionByName(some.mapInArrow(_scan(shared, kept), out.schema))
    return out


def base_name(file: Column) -> Column:
    return F.regexp_extract(file, r"[^/]*$", 0)


def mentioned(snippets: DataFrame, files: DataFrame, block: int = BLOCK) -> DataFrame:
    """(theme, file, id): snippets of a theme (theme, id, text) that contain a file of it (theme, file) or its base name."""
    named = _named(files)
    met = containing(snippets.select("id", "theme", "text"), named.select("pattern"), block)
    return met.join(named, ["theme", "pattern"]).select("theme", "file", "id").distinct()


def _named(files: DataFrame) -> DataFrame:
    """theme, file, pattern: what to look for, the base name, since it ends the file and so is wherever the file is."""
    return files.where("file is not null").select("theme", "file", base_name(F.col("file")).alias("pattern")).distinct()


def changes_of(snippet: Column) -> Column:
    """Array of (type, content): lines added, deleted and of context; blank lines and lines of hunk or diff heads are none."""
    bare = lambda line: F.regexp_replace(line, f"^{SPACE}|{SPACE}$", "")

    def change(line: Column) -> Column:
        kind = F.when(F.startswith(line, F.lit("+")), "add").when(F.startswith(line, F.lit("-")), "delete").when((bare(line) != "") & ~F.startswith(line, F.lit("@@")) & ~F.startswith(line, F.lit("diff")), "context")
        return F.struct(kind.alias("type"), F.when(kind == "context", bare(line)).otherwise(bare(F.substring(line, 2, 1 << 30))).alias("content"))

    return F.filter(F.transform(F.split(snippet, "\n"), change), lambda c: c["type"].isNotNull())


def to_diff(snippets: DataFrame, files: DataFrame, block: int = BLOCK) -> DataFrame:
    """theme, file, id, first_line, changes: for each file the changes of the snippets that mention it, in order of id.

    Lines of a file count on over its snippets: ``first_line`` comes from the snippets' sizes, so the lines
    themselves need no common order."""
    parsed = snippets.select("theme", "id", changes_of(F.col("text")).alias("changes")).where(F.size("changes") > 0)
    met = mentioned(snippets, files, block).join(parsed, ["theme", "id"])
    before = F.sum(F.size("changes")).over(W.partitionBy("theme", "file").orderBy("id").rowsBetween(W.unboundedPreceding, -1))
    return met.withColumn("first_line", F.coalesce(before, F.lit(0)) + 1)


def heads(diff: DataFrame) -> DataFrame:
    """One hunk a file: theme, file, snippets, old_lines, new_lines, end_line, context_type."""
    n = lambda *kinds: F.sum(F.size(F.filter("changes", lambda c: c["type"].isin(*kinds))))
    out = diff.groupBy("theme", "file").agg(F.count(F.lit(1)).alias("snippets"), n("delete", "context").alias("old_lines"), n("add", "context").alias("new_lines"), F.sum(F.size("changes")).alias("end_line"))
    return out.withColumn("context_type", pred.context_type(F.col("file")))


def counted(snippet: Column) -> Column:
    """Struct of how many ``changes_of`` a snippet are added, deleted and of context."""
    begins = lambda x, mark: F.startswith(x, F.lit(mark))
    context = lambda x: ~begins(x, "+") & ~begins(x, "-") & ~begins(x, "@@") & ~begins(x, "diff") & x.rlike(r"[^ \t\r\n\f\x0B]")
    n = lambda lines, test: F.size(F.filter(lines, test)).cast("long")
    return let(
        F.split(snippet, "\n"),
        lambda lines: F.struct(n(lines, lambda x: begins(x, "+")).alias("added"), n(lines, lambda x: begins(x, "-")).alias("deleted"), n(lines, context).alias("context")),
    )


def file_heads(snippets: DataFrame, files: DataFrame, block: int = BLOCK) -> DataFrame:
    """``heads`` of ``to_diff`` without its lines, with the last snippet's first line and the first snippet's id.

    Snippets are counted once each and met by name; what is found is added up by name before files meet it, so neither lines nor
    pairs of files and snippets travel. The last snippet begins behind all others, so no running sum is needed."""
    named = stored(_named(files))
    met = _matches(snippets.select("theme", "id", "text", counted(F.col("text")).alias("n")), stored(named.select("pattern").distinct()), block).select("*", "n.*")
    every = F.col("added") + F.col("deleted") + F.col("context")
    of_name = met.where(every > 0).groupBy("theme", "pattern").agg(
        F.count(F.lit(1)).alias("snippets"), F.sum(F.col("deleted") + F.col("context")).alias("old_lines"), F.sum(F.col("added") + F.col("context")).alias("new_lines"),
        F.sum(every).alias("end_line"), F.max_by(every, F.col("id")).alias("last"), F.min("id").alias("first_id"),
    )
    rows = named.join(of_name, ["theme", "pattern"])
    return rows.select("theme", "file", "snippets", "old_lines", "new_lines", "end_line", (F.col("end_line") - F.col("last") + 1).alias("last_start"), "first_id")
