"""The theme fold against a sequential one: any split into batches, any order of rows, restarts, chains of names."""

from __future__ import annotations

import random

import pytest

from weftline.operators import themes

BATCH = "seq long, name string, description string, confidence double, parent string, filename string"


def fold(rows, confidence=0.7, likeness=0.6):
    """One analysis after the other over a list of themes."""
    kept, out = [], []
    for seq, name, description, sure, parent, _ in sorted(rows, key=lambda r: r[0]):
        at = next((t for t in kept if t[1].lower() == parent.lower()), None) if parent else None
        if at is not None and (sure or 0.0) > confidence:
            a, b = (description or "").lower().split(" "), at[2].lower().split(" ")
            if sum(w in b for w in a) / max(len(a), len(b)) > likeness:
                out.append((seq, "merge", at[0]))
                continue
        kept.append((seq, name or "", description or ""))
        out.append((seq, "create", seq))
    return sorted(out), [t[0] for t in kept]


def analyses(n, seed):
    rng = random.Random(seed)
    names = ["Login", "login", "LOGOUT", "Cart", "cart", "Search", None, ""]
    words = lambda: " ".join(rng.choice(["user", "page", "form", "state"]) for _ in range(rng.randint(1, 4)))
    return [(i * 3, rng.choice(names), rng.choice([words(), words(), None]), rng.choice([0.2, 0.7, 0.71, 0.9, None]), rng.choice([*names, "nobody"]), f"f{i}.ts") for i in range(n)]


def folded(spark, batches):
    state, placed = spark.createDataFrame([], themes.THEMES), []
    for batch in batches:
        df = spark.createDataFrame(batch, BATCH)
        where = themes.placed(state, df)
        placed += [tuple(r) for r in where.collect()]
        state = themes.grown(state, df, where)
    return sorted(placed), state


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_gives_the_sequential_fold(spark, seed):
    rows = analyses(60, seed)
    want, founded = fold(rows)
    assert any(a == "merge" for _, a, _ in want)
    shuffled = rows[:]
    random.Random(seed).shuffle(shuffled)
    placed, state = folded(spark, [shuffled])
    assert placed == want and sorted(r["seq"] for r in state.collect()) == founded
    placed, state = folded(spark, [rows[:20], rows[20:45], rows[45:]])
    assert placed == want and sorted(r["seq"] for r in state.collect()) == founded


def test_restart_from_a_written_state(spark, tmp_path):
    rows = analyses(40, 3)
    _, state = folded(spark, [rows[:25]])
    state.write.parquet(str(tmp_path / "state"))
    again = spark.read.schema(themes.THEMES).parquet(str(tmp_path / "state"))
    late = spark.createDataFrame(rows[25:], BATCH)
    found = sorted(tuple(r) for r in themes.placed(again, late).collect())
    assert found == [r for r in fold(rows)[0] if r[0] >= 75]


def test_a_chain_of_names(spark):
    """Each analysis waits for the one before it, which may merge or found the name it asks for."""
    rows = [(i, f"n{i}", "a b c", 0.9, f"n{i - 1}", "f") for i in range(6)] + [(10 + i, f"n{i}", "x y z", 0.9, f"n{i + 1}", "f") for i in range(5)]
    assert folded(spark, [rows])[0] == fold(rows)[0]
    assert folded(spark, [[]])[0] == []


def test_contents(spark):
    rows = [(1, "Cart", "add to cart", 0.5, None, "a.ts"), (2, "Other", "add to cart", 0.9, "CART", "b.ts"), (3, "More", "add to cart now", 0.9, "cart", "c.ts")]
    df = spark.createDataFrame(rows, BATCH)
    where = themes.placed(spark.createDataFrame([], themes.THEMES), df)
    assert [tuple(r) for r in themes.contents(where, df).collect()] == [(1, 3, 2, "a.ts,b.ts,c.ts", "add to cart\nadd to cart\nadd to cart now")]
