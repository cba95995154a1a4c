"""Expansion outcomes, nested assignments, snippets and spans against plain Python."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from weftline.functions import assignments
from weftline.functions import predicates as pred
from weftline.operators import expansion, snippets, spans


def test_expansion_outcomes(spark):
    roots = [("r", None, "Root", "d", 0, ["a", "b", "c"], ["see a", "see z"], "ctx"), ("s", None, "Alone", "d", 0, ["a"], None, None), ("t", None, "Broken", "d", 0, ["a"], None, None), ("u", None, "Lost", "d", 0, ["a"], None, None), ("v", None, "Unasked", "d", 0, None, None, None), ("w", None, "Same", "d", 0, ["a"], None, None)]
    child = lambda name, files=None, relevant=None, impact=None, why=None: (name, f"about {name}", files, relevant, impact, why)
    decisions = [
        ("r", True, False, None, None, [child("one", ["a", "x"], impact="big"), child("two", None, ["b"], "", "since")]),
        ("s", False, True, "small", None, None), ("t", True, False, None, "timeout", [child("one", ["a"])]), ("u", True, False, None, None, [child("good", ["a"]), child("none", [], ["a"]), child("far", ["q"])]),
        ("w", True, False, None, None, []), ("r_sub_0", True, False, None, None, [child("deep", ["x"])]), ("r_sub_1", False, False, "", None, None),
    ]
    nodes, outcomes = expansion.expanded(spark.createDataFrame(roots, expansion.NODE), spark.createDataFrame(decisions, expansion.DECISION))
    got = {r["id"]: (r["depth"], r["outcome"], r["reason"], r["details"], r["file_count"], r["n_children"], r["unassigned"]) for r in outcomes.collect()}
    assert got == {
        "r": (0, "expanded", None, None, 3, 2, 1), "s": (0, "stopped", "atomic", "small", 1, 0, 0), "t": (0, "failed", "error", "timeout", 1, 0, 0), "u": (0, "failed", "no-files", "none", 1, 0, 0),
        "v": (0, "stopped", "ai-decision", "AI decision", 0, 0, 0), "w": (0, "unchanged", None, None, 1, 0, 0), "r_sub_0": (1, "failed", "invalid-files", "deep", 1, 0, 0), "r_sub_1": (1, "stopped", "ai-decision", "AI decision", 1, 0, 0),
    }
    by = {r["id"]: r for r in nodes.collect()}
    one, two = by["r_sub_0"], by["r_sub_1"]
    assert (one["files"], one["snippets"], one["impact"], one["confidence"], one["level"], one["is_atomic"]) == (["a"], ["see a"], "big", 0.8, 1, False)
    assert (two["files"], two["snippets"], two["impact"], two["context"]) == (["b"], [], "since", "ctx\n\nSub-theme: about two")
    tall = {r["id"]: (r["below"], r["height"], r["leaf_files"]) for r in expansion.rebuilt(nodes).collect()}
    assert tall["r"] == (2, 1, 2) and tall["r_sub_0"] == (0, 0, 1) and tall["v"] == (0, 0, 0)
    reasons = {(r["depth"], r["outcome"], r["reason"]): r["nodes"] for r in expansion.stop_reasons(outcomes).collect()}
    assert reasons[(0, "failed", "no-files")] == 1 and sum(reasons.values()) == 8


def test_expansion_of_nothing(spark):
    nodes, outcomes = expansion.expanded(spark.createDataFrame([], expansion.NODE), spark.createDataFrame([], expansion.DECISION))
    assert nodes.collect() == outcomes.collect() == expansion.rebuilt(nodes).collect() == []


def test_assignments(spark):
    change, bad = ("add", "x"), ("", "y")
    hunk = lambda *changes, start=None: (None, 2, start, None, list(changes))
    rows = [
        [
            ("a " * 9 + "z", "", None, "why", [("f", [hunk(change, bad, start=3), hunk(bad), (1, 1, 1, 1, None), hunk(("delete", ""), start=9)], None), ("", [hunk(change)], None), ("g", None, None), ("h", [hunk(bad)], "reference")], None, ""),
            ("", "d", None, "why", [("f", [hunk(change)], None)], None, None), ("n", "d", None, None, [], None, None), ("n", "d", None, "why", None, None, None), ("n", "d", "value", "why", [], "r", "m"), ("n", "d", "value", "why", [("f", [], None)], "r", "m"),
        ],
        [], None,
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"id int, a array<{assignments.ASSIGNMENT}>")
    found = df.select("id", assignments.kept(F.col("a")).alias("kept"), assignments.violations(F.col("a")).alias("v"), F.transform("a", assignments.problem).alias("p")).orderBy("id").collect()
    assert [len(k["kept"] or []) for k in found] == [1, 0, 0] and found[2]["kept"] is None and found[1]["v"] == []
    kept = found[0]["kept"][0]
    assert kept["name"] == "a a a a a a a a" and kept["business_value"] == "a " * 9 + "z" and kept["description"] == "why" and kept["rationale"] == "Distinct concern" and kept["contextual_meaning"] == "why"
    code = kept["assigned_code"]
    assert len(code) == 1 and code[0]["ownership"] == "primary" and (code[0]["start_line"], code[0]["end_line"]) == (3, 9)
    assert [(h["old_start"], h["old_lines"], h["new_start"], [tuple(c) for c in h["changes"]]) for h in code[0]["hunks"]] == [(0, 2, 3, [("add", "x")]), (0, 2, 9, [("delete", "")])]
    said = [(v["path"], v["reason"]) for v in found[0]["v"]]
    c = "[0].assigned_code"
    assert said == [
        (f"{c}[0].hunks[0].changes[1]", "missing type"), (f"{c}[0].hunks[1]", "no valid changes"), (f"{c}[0].hunks[1].changes[0]", "missing type"), (f"{c}[0].hunks[2]", "missing changes"),
        (f"{c}[1]", "missing file"), (f"{c}[2]", "missing hunks"), (f"{c}[3]", "no valid hunks"), (f"{c}[3].hunks[0]", "no valid changes"), (f"{c}[3].hunks[0].changes[0]", "missing type"),
        ("[1]", "missing name"), ("[2]", "missing technical_purpose"), ("[3]", "missing assigned_code"), ("[4]", "no valid code"), ("[5]", "no valid code"), ("[5].assigned_code[0]", "no valid hunks"),
    ]
    assert found[0]["p"] == ["empty hunk", None, "no assigned code", "no assigned code", "no assigned code", "invalid code"]


def test_containing_is_a_nested_loop_without_one(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("ab/.") for _ in range(n))
    texts = [(i, word(rng.randint(0, 40))) for i in range(60)] + [(60, None), (61, "")]
    patterns = [word(rng.randint(0, 4)) for _ in range(40)] + [None, "", "漢"]
    want = sorted({(i, p) for i, t in texts if t is not None for p in patterns if p is not None and p in t})
    frames = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string")
    for block in (7, 1000):
        assert sorted(tuple(r) for r in snippets.containing(*frames, block=block).collect()) == want
    assert snippets.containing(frames[0], frames[1].limit(0)).collect() == []


def test_snippets_to_diff(spark):
    shown = spark.createDataFrame([("t", 1, "diff --git\n@@ -1 +1 @@\n+ new a.ts \n-old\n\n same  "), ("t", 2, "+x in src/b.ts"), ("t", 3, "+a.ts again\n  \n+"), ("u", 4, "+a.ts elsewhere")], "theme string, id long, text string")
    files = spark.createDataFrame([("t", "src/a.ts"), ("t", "src/b.ts"), ("t", "src/a.ts"), ("t", "c.test.ts"), ("u", "z")], "theme string, file string")
    diff = snippets.to_diff(shown, files)
    rows = {(r["file"], r["id"]): (r["first_line"], [tuple(c) for c in r["changes"]]) for r in diff.collect()}
    assert rows == {("src/a.ts", 1): (1, [("add", "new a.ts"), ("delete", "old"), ("context", "same")]), ("src/a.ts", 3): (4, [("add", "a.ts again"), ("add", "")]), ("src/b.ts", 2): (1, [("add", "x in src/b.ts")])}
    assert sorted(tuple(r) for r in snippets.heads(diff).collect()) == [("t", "src/a.ts", 2, 2, 4, 5, "function"), ("t", "src/b.ts", 1, 0, 1, 1, "function")]


def test_context_type(value):
    for path, want in (("src/latest.ts", "test"), ("a.spec.js", "test"), ("my.config.ts", "config"), ("a.yml", "config"), ("a.js", "function"), ("utils/a.py", "module")):
        assert value(pred.context_type(F.col("p")), p=path) == want


def stack(rows):
    """Spans of one thread by a stack: seq -> (depth, parent, status, duration)."""
    out, held = {}, []
    for seq, at, name, opens in sorted(rows, key=lambda r: (r[1], r[0])):
        if opens is None:
            continue
        if opens:
            out[seq] = (len(held) + 1, held[-1][0] if held else None, "open", None)
            held.append((seq, at, name))
        elif held:
            s, began, called = held.pop()
            out[s] = (*out[s][:2], *(("closed", at - began) if called == name else ("mismatched", None)))
    return out


def test_spans(spark):
    rng = random.Random(6)
    rows = [(t, i, rng.randrange(300), rng.choice(["a", "b", None]), rng.choice([True, True, False, False, None])) for t in range(4) for i in range(120)]
    found = spans.shares(spans.nested(spark.createDataFrame(rows, "thread int, seq int, at long, name string, opens boolean"))).collect()
    for t in range(4):
        want = stack([r[1:] for r in rows if r[0] == t])
        assert {r["seq"]: (r["depth"], r["parent"], r["status"], r["duration"]) for r in found if r["thread"] == t} == want
        for r in (r for r in found if r["thread"] == t):
            kids = [v for v in want.values() if v[1] == r["seq"]]
            assert r["children"] == len(kids) and (r["duration"] is None or r["self_time"] == r["duration"] - sum(v[3] or 0 for v in kids))
            over = want[r["parent"]][3] if r["parent"] is not None else None
            assert r["bottleneck"] == bool(over and (r["duration"] or 0) / over > 0.7)


def test_containing_reads_texts_once_for_many_patterns(spark):
    texts = spark.createDataFrame([(i, f"see dir{i:06d}/file é{i:06d}.ts, and so on") for i in range(300)], "id long, text string")
    patterns = spark.range(120_000).select(F.format_string("file é%06d.ts", "id").alias("pattern"))
    found = snippets.containing(texts, patterns)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted(tuple(r) for r in found.collect()) == [(i, f"file é{i:06d}.ts") for i in range(300)]


def test_file_heads_are_those_of_the_diff(spark):
    shown = spark.createDataFrame(
        [("t", 1, "diff --git\n@@ -1 +1 @@\n+ new a.ts \n-old\n\n same  "), ("t", 2, "+x in src/b.ts"), ("t", 3, "+a.ts again a.ts\n  \n+"), ("u", 4, "+a.ts elsewhere"), ("t", 5, "diff a.ts\n\t"), ("t", 6, None)],
        "theme string, id long, text string",
    )
    files = spark.createDataFrame([("t", "src/a.ts"), ("t", "lib/a.ts"), ("t", "src/b.ts"), ("t", "src/a.ts"), ("u", "z"), ("u", "all/"), ("t", None)], "theme string, file string")
    diff = snippets.to_diff(shown, files)
    more = {(r["theme"], r["file"]): (r["s"], r["i"]) for r in diff.groupBy("theme", "file").agg(F.max("first_line").alias("s"), F.min("id").alias("i")).collect()}
    want = sorted((*tuple(r)[:6], *more[r["theme"], r["file"]]) for r in snippets.heads(diff).collect())
    for block in (1, 1000):
        found = snippets.file_heads(shown, files, block)
        assert sorted(tuple(r) for r in found.collect()) == want and len(want) == 4
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("MapInArrow") == 1  # no lines are dealt by file


def test_texts_of_one_hash_are_told_apart():
    row, h, text = np.array([1, 0, 1, 1]), np.array([5, 5, 5, 5], np.uint64), np.array([list(b"ab"), list(b"ab"), list(b"cd"), list(b"ab")], np.uint8)
    own, found = snippets._once(row, h, text)
    assert sorted(zip(own.tolist(), found.to_pylist(), strict=True)) == [(0, "ab"), (1, "ab"), (1, "cd")]
