"""Lookup by likeness as of a time against a scan of the whole log; invalidation by files and prefixes."""

from __future__ import annotations

import random

from weftline.operators import semantic

STORES = "context string, key string, at long, ttl long, seq long, tokens array<string>"
LOOKUPS = "lookup long, context string, key string, at long, tokens array<string>"


def scan(lookups, stores, likeness):
    """Replay: a list of living answers in the order in which their keys came in."""
    out = []
    for lookup, context, key, at, tokens in lookups:
        alive = {}
        for c, k, t, ttl, seq, words in sorted(stores, key=lambda s: (s[2], s[4])):
            if t > at:
                break
            for old in [x for x, v in alive.items() if v[0] < t]:
                del alive[old]
            alive[(c, k)] = (t + ttl, seq, set(words), alive[(c, k)][3] if (c, k) in alive else seq)
        living = sorted((v[3], v[1], x, v[2]) for x, v in alive.items() if v[0] >= at and x[0] == context)
        exact = [seq for _, seq, x, _ in living if x[1] == key]
        want = set(tokens)
        near = [(seq, len(want & w) / len(want | w)) for _, seq, _, w in living if want and w and len(want & w) / len(want | w) >= likeness]
        out.append((lookup, "exact", exact[0], 1.0) if exact else (lookup, "semantic", *near[0]) if near else (lookup, "miss", None, None))
    return sorted(out)


def test_against_a_scan(spark):
    rng = random.Random(4)
    words = lambda: rng.sample("abcdefgh", rng.randint(0, 5))
    stores = [(rng.choice("XY"), rng.choice(["k1", "k2", f"k{i}"]), rng.randrange(400), rng.choice([0, 5, 60]), i, words()) for i in range(150)]
    lookups = [(i, rng.choice("XYZ"), rng.choice(["k1", "nokey"]), rng.randrange(420), words()) for i in range(120)]
    found = semantic.found(spark.createDataFrame(lookups, LOOKUPS), spark.createDataFrame(stores, STORES), 0.6)
    got = sorted((r["lookup"], r["kind"], r["store"], r["similarity"]) for r in found.collect())
    want = scan(lookups, stores, 0.6)
    assert got == want and {k for _, k, _, _ in want} == {"exact", "semantic", "miss"}


def test_empty_log(spark):
    lookups = spark.createDataFrame([(1, "X", "k", 5, ["a"])], LOOKUPS)
    assert [tuple(r) for r in semantic.found(lookups, spark.createDataFrame([], STORES)).select("lookup", "kind", "store").collect()] == [(1, "miss", None)]


def test_no_cross_join(spark):
    left = spark.createDataFrame([("X", ["a", "b"])], "context string, tokens array<string>")
    plan = semantic.similar_sets(left, left, "context", 0.85)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan


def test_invalidation(spark):
    entries = spark.createDataFrame([("theme:a", ["x.ts", "y.ts"]), ("theme:b", []), ("code:c", None), ("code:d", ["z.ts"]), ("t", ["q.ts"])], "key string, files array<string>")
    modified = spark.createDataFrame([("y.ts",), ("y.ts",), ("other",)], "file string")
    keys = lambda df: sorted(r["key"] for r in df.collect())
    assert keys(semantic.invalidated(entries, modified)) == ["code:c", "code:d", "t", "theme:b"]
    assert keys(semantic.invalidated(entries, modified.limit(0))) == keys(entries)
    prefixes = spark.createDataFrame([("theme:",), ("code:d",), (None,)], "prefix string")
    assert keys(semantic.without_prefix(entries, prefixes)) == ["code:c", "t"]
    assert keys(semantic.without_prefix(entries, prefixes.limit(0))) == keys(entries)
