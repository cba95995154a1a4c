"""Product codes against a full search in plain integers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from weftline.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string"


def brute(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error, digest) of valid rows of one dimension, by full search."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows]
    width = len(kept[0][1]) // parts
    first = {}
    for i, v, _ in kept:
        first.setdefault(i, v)
    seeds = list(first.values())[:entries]
    books = [[s[p * width : (p + 1) * width] for s in seeds] for p in range(parts)]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = [nearest(x[p], books[p])[1] for x in cut]
            for e in range(len(seeds)):
                mine = [x[p] for x, o in zip(cut, of, strict=True) if o == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [[nearest(x[p], books[p]) for p in range(parts)] for x in cut]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors, total = [sum(d for d, _ in f) for f in found], {}
    for (_, _, lab), e in zip(kept, errors, strict=True):
        total[lab] = total.get(lab, 0) + e
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), err, total[lab], digest) for (i, _, lab), f, err in zip(kept, found, errors, strict=True)), key=repr)


def coded(df):
    return sorted((tuple(r) for r in vector_codes.encode(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def test_against_full_search(spark):
    """Ties (coarse values, repeated vectors, equal entries), null ids and labels, rows that are dropped."""
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, -0.25, 0.0, 0.25, 0.5]) + (i % 3) * 1e-4 for _ in range(16)], rng.choice([None, 1, 2])) for i in range(300, 0, -1)]
    rows += [(7, [0.25] * 16, 1), (7, [0.25] * 16, 1), (None, [9.5, -9.5] * 8, None), (2, [0.5] * 16, 2)]
    rows = [(i, np.float32(v).tolist(), lab) for i, v, lab in rows]
    bad = [(0, None, 1), (-1, [], 1), (-2, [float("nan")] + [0.0] * 15, 1), (-3, [None] + [0.0] * 15, 1), (-4, [float("inf")] * 16, 1), (1000, [0.0] * 8, 1)]
    df = spark.createDataFrame([(*r, "c", "e") for r in rows + bad], SCHEMA).repartition(5)
    assert coded(df) == brute(rows)


def test_few_rows_and_none(spark):
    rows = [(i, [float(i), -0.00001] * 4, None) for i in range(3)]
    rows = [(i, np.float32(v).tolist(), lab) for i, v, lab in rows]
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    assert coded(df) == brute(rows)
    assert coded(df.where("vec_id < 0")) == []
    assert coded(spark.createDataFrame([(1, [1.0] * 9, 1, "", "")], SCHEMA)) == []
    with pytest.raises(Exception, match="below"):
        vector_codes.encode(spark.createDataFrame([(1, [1e9] * 8, 1, "", "")], SCHEMA)).collect()


def test_many_labels_take_the_salted_join(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, np.float32([rng.gauss(0, 0.2) for _ in range(8)]).tolist(), rng.choice([None, 1, 2, 3, 3, 3])) for i in range(120)]
    monkeypatch.setattr(vector_codes, "LABELS", 2)
    assert coded(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)) == brute(rows)


def test_search_from_any_entry_is_a_full_search():
    """Exponion's radius and tie rule, on entries that repeat and on every start."""
    rng = np.random.default_rng(3)
    entries = np.concatenate([rng.integers(-6, 6, (13, 4)), np.zeros((2, 4), np.int64), rng.integers(-6, 6, (1, 4))])
    x = rng.integers(-9, 9, (500, 4))
    full = ((x[:, None, :] - entries[None]) ** 2).sum(2)
    for start in range(16):
        code, least = vector_codes.Entries(entries).nearest(x, np.full(500, start, np.uint8))
        assert (code == full.argmin(1)).all() and (least == full.min(1)).all()
    wide = rng.integers(-40_000, 40_000, (20, 8))
    import pyarrow as pa

    mixed = pa.array(vector_codes._packed(wide) + vector_codes._packed(wide // 10), pa.binary())
    assert (vector_codes._unpacked(mixed, 8) == np.concatenate([wide, wide // 10])).all()
