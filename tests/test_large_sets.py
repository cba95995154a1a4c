"""Pairs of large sets: sets go where their near copies meet, not with each pair; texts without a language are like none."""

from __future__ import annotations

import random

from weftline.operators import relational
from weftline.plans import linking


def test_sets_travel_by_set_and_not_by_pair(spark):
    clique = [(a, b) for b in range(600) for a in range(b)]
    left, right = relational.homes(spark.createDataFrame(clique + [(700, 701), (701, 702)], "a long, b long"))
    at = lambda df: [(r["home"], r["part"], r["k"]) for r in df.collect()]
    left, right = at(left), at(right)
    assert len(left) == 601 and len(right) <= 3 * 599 + 2  # 179,702 pairs
    there = {}
    for h, p, k in right:
        there.setdefault((h, p), set()).add(k)
    met = [(a, b) for h, p, a in left for b in there[h, p] if a < b]
    assert len(met) == len(set(met)) and {*clique, (700, 701), (701, 702)} <= set(met)


def test_coded_sets_against_all_pairs(spark):
    rng = random.Random(3)
    words, rows = [f"word{i}" for i in range(900)], []
    for i in range(20):
        base = rng.sample(words, 120)
        rows += [(10 * i + j, "xy"[j % 2], [w for w in base if rng.random() > 0.03] + rng.sample(["a", "b", "c"], 1)) for j in range(6)]
    coded = relational.coded(spark.createDataFrame(rows, "k long, lang string, w array<string>"), "k", "w", ["lang"])
    assert all(r["s"] == sorted(set(r["s"])) for r in coded.collect())
    found = {(r["a"], r["b"]): r["similarity"] for r in relational.overlap_pairs(coded, "k", "s", 0.85, ranked=True).collect()}
    like = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    want = {(i, j): like(x, y) for i, lx, x in rows for j, ly, y in rows if i < j and lx == ly and like(x, y) >= 0.85}
    assert found == want and want


def test_no_language_is_like_none(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [(1, None, text), (2, None, text + " more"), (3, "en", text), (4, "en", text + " more"), (5, "en", text), (6, "de", text), (7, "en", None), (8, "en", "")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = linking.semantic_key_jaccard(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in found] == [(3, 4, 2, 1, round(30 / 31, 6))]
