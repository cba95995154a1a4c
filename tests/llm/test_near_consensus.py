"""Near-duplicate groups of many edited copies of one text, dealt by consensus instead of pair by pair."""

from __future__ import annotations

import random

import pytest

from weftline.llm import near_dedup


def all_pairs(rows, similarity=0.8):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows if (w := t.split())}
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similarity:
                x, y = sorted((root(a), root(b)))
                least[y] = x
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_edited_copies_of_one_text(spark, monkeypatch, seed):
    """Copies with few to many words changed, added or left out: some alike, many just below."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(130):
        w = base[:]
        for _ in range(rng.choice([1, 2, 2, 3, 3, 4])):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[f"x{rng.randrange(40)}"], [w[at], f"y{rng.randrange(40)}"], []])
        rows.append((i, " ".join(w[rng.choice([0, 0, 0, 8]) :])))
    dealt = []
    real = near_dedup._by_consensus
    monkeypatch.setattr(near_dedup, "_by_consensus", lambda *a: dealt.append(1) or real(*a))
    found = near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"), turns=1, few=(4, 6))
    assert {r["doc_id"]: r["group_id"] for r in found.collect()} == all_pairs(rows)
    assert dealt


def test_components_grow_with_their_links(spark):
    """Links of a later turn join the components of the earlier ones: same result as from all links, and only those between components are followed."""
    rng = random.Random(7)
    links = [(a, b) for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(190)) if a != b]
    scale = near_dedup._Scale(300)
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    read = lambda df: sorted(map(tuple, df.collect()))
    first = near_dedup.components(frame(links[:120]), scale)
    assert read(near_dedup._merged(first, frame(links[120:]), scale)) == read(near_dedup.components(frame(links), scale))
    assert near_dedup._merged(first, frame(links[:50]), scale) is first


@pytest.mark.parametrize("voters", [1, 64])
def test_consensus_of_large_buckets(spark, monkeypatch, voters):
    """Buckets of the same members are dealt once, a few members vote for all, and every similar pair still meets, whoever votes."""
    rng = random.Random(11)
    base = list(range(200))
    sets = {i: sorted(set(rng.sample(base, 185)) | {1000 + rng.randrange(60) for _ in range(rng.randrange(25))}) for i in range(300)}
    count = {}
    for x in (x for s in sets.values() for x in s):
        count[x] = count.get(x, 0) + 1
    shared = spark.createDataFrame([(i, sorted(s, key=lambda x: (count[x], x))) for i, s in sets.items()], "doc long, shared array<long>")
    sizes = spark.createDataFrame([(i, len(s)) for i, s in sets.items()], "doc long, size int")
    large = spark.createDataFrame([(k, i, 300) for k in range(8) for i in sets], "key long, doc long, n long")
    monkeypatch.setattr(near_dedup, "VOTERS", voters)
    met = {}
    for r in near_dedup._by_consensus(large, shared, sizes, 0.8).collect():
        met.setdefault(r["key"], []).append(r["doc"])
    once = {k for k in met if len(met[k]) > 1}
    together = {(a, b) for k in once for a in met[k] for b in met[k] if a < b}
    sets = {i: set(s) for i, s in sets.items()}
    near = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert near and near <= together
    per_doc = sum(map(len, met.values())) / len(sets)
    again = near_dedup._by_consensus(large.where("key = 0"), shared, sizes, 0.8).count() / len(sets)
    assert per_doc == again  # eight buckets of the same members cost what one does


def test_plans_stay_small(spark, monkeypatch):
    """No step of the dealing repeats another's plan for each of its readers: the driver holds each plan whole (84 tables were read in one before)."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(60):
        w = base[:]
        for _ in range(rng.choice([2, 3, 4])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    leaves = {}
    real = near_dedup.materialise
    monkeypatch.setattr(near_dedup, "materialise", lambda df, label: leaves.setdefault(label, []).append(df._jdf.queryExecution().analyzed().collectLeaves().size()) or real(df, label))
    found = near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"), turns=1, few=(4, 6))
    assert {r["doc_id"]: r["group_id"] for r in found.collect()} == all_pairs(rows)
    assert "dealt" in leaves
    assert max(n for found in leaves.values() for n in found) <= 20, leaves
