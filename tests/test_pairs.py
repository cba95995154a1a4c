"""Pairs of similar sets: what travels to the join, and results against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from weftline.operators import cluster, crossref, relational, semantic


def near_copies(rng, groups, size, words):
    out = []
    for _ in range(groups):
        base = rng.sample(range(words), size)
        for _ in range(rng.randint(1, 4)):
            out.append([x for x in base if rng.random() > 0.04] + rng.sample(range(words), rng.randint(0, 3)))
    return out


@pytest.mark.parametrize("size", [6, 150])  # sets that travel with their items, and larger ones
def test_overlap_pairs_against_all_pairs(spark, size):
    sets = near_copies(random.Random(size), 25, size, size * 8) + [[], [1]]
    df = spark.createDataFrame([(i, [*s, None]) for i, s in enumerate(sets)], "k long, s array<int>")
    got = {(r["a"], r["b"]): r["similarity"] for r in relational.overlap_pairs(df, "k", "s", 0.8).collect()}
    want = {}
    for j, y in enumerate(sets):
        for i, x in enumerate(sets[:j]):
            if x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.8:
                want[i, j] = len(set(x) & set(y)) / len(set(x) | set(y))
    assert got == want and want


def test_only_names_travel_to_the_join(spark):
    df = spark.createDataFrame([("X", 1, ["a", "b", "c"])], "context string, set long, tokens array<string>")
    sets = semantic.ranked_sets(df, "context", "set")
    rows = relational.entries(sets, ["set", "context"], 0.85, "l")
    assert not [f.name for f in rows.schema if isinstance(f.dataType, ArrayType)] and rows.count() == 1


def test_sets_of_other_times_are_not_compared(spark):
    df = spark.createDataFrame([("X", i, ["a", "b", "c"]) for i in range(6)], "context string, set long, tokens array<string>")
    sets = semantic.ranked_sets(df, "context", "set")
    side = sets.select("set", (F.col("set") % 3).alias("_b"))
    assert sorted((r["l"], r["r"]) for r in semantic.similar(sets, side, side, "context", 0.85).collect()) == [(i, j) for i in range(6) for j in range(6) if i % 3 == j % 3]


def test_related_pairs_are_not_shuffled(spark):
    nodes = spark.createDataFrame([(f"n{i}", i, f"name {i % 3}", ["d/f"], f"w{i % 4} common") for i in range(12)], "id string, ord long, name string, affected_files array<string>, context string")
    plan = crossref.related(nodes)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Aggregate" in line and "id2" in line]
    assert crossref.related(nodes).count() == 66


def test_leaders_shed_edges_until_few_are_left(spark):
    rng = random.Random(2)
    edges = sorted({tuple(sorted(rng.sample(range(80), 2))) for _ in range(300)})
    want = {}
    for i in range(90):
        if want.setdefault(i, i) == i:
            for a, b in edges:
                if a == i:
                    want.setdefault(b, i)
    items, df = spark.range(90).withColumnRenamed("id", "k"), spark.createDataFrame(edges, "a long, b long")
    for limit in (1_000_000, 40, 0):
        assert {r["item"]: r["leader"] for r in cluster.leaders(items, df, "k", limit).collect()} == want
