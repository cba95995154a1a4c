"""Operators on small literal frames."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import crossref, diff, metrics, ordered, relational, render, review, state, tree
from weftline.sources import readers

PATCH = "\n".join(["diff --git a b", "+++ b/x", "@@ -1,2 +1,3 @@ function foo", " a", "-b", "+c", "+d", "@@ -5 +7 @@", " z"])


@pytest.fixture(scope="module")
def files(spark):
    rows = [
        ("src/a.ts", PATCH), ("src/b.ts", "@@ -1 +1,2 @@\n+export const shared = 1\n+import { x } from 'lib'"),
        ("src/c.ts", "@@ -0,0 +1 @@\n+import { shared } from './b'"), ("src/b.test.ts", "@@ -1 +1 @@\n-export default function Old"),
    ]
    return spark.createDataFrame(rows, "filename string, patch string")


def test_hunks(files):
    rows = diff.lines(files).where("file = 'src/a.ts'").orderBy("hunk_id", "idx").collect()
    assert [(r["hunk_id"], r["type"], r["line_number"], r["content"]) for r in rows] == [(0, "context", 1, "a"), (0, "delete", -1, "b"), (0, "add", 2, "c"), (0, "add", 3, "d"), (1, "context", 7, "z")]
    heads = diff.hunks(files).where("file = 'src/a.ts'").orderBy("hunk_id").collect()
    assert (heads[0]["semantic_context"], heads[1]["old_lines"], heads[1]["new_lines"]) == ("foo", 1, 1)


def test_hunks_are_numbered_in_their_rows(spark, files):
    """Lines are neither shuffled nor sorted; heads within a line, adjacent heads, blank lines and nulls."""
    plan = diff.lines(files)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan
    assert "Window" not in diff.hunks(files)._jdf.queryExecution().executedPlan().toString()
    odd = spark.createDataFrame([("x", "lost\n@@ -1 +4 @@\nx @@ -2,3 +9,1 @@ class A\n\n-a\n\n+b\n\\c\n@@ nothing @@\n-d\n"), ("y", None), ("z", "+a\n-b")], "filename string, patch string")
    got = [(r["hunk_id"], r["idx"], r["type"], r["line_number"], r["content"]) for r in diff.lines(odd).orderBy("hunk_id", "idx").collect()]
    assert got == [(1, 0, "delete", -1, "a"), (1, 1, "add", 9, "b"), (1, 2, "context", 10, "c"), (1, 3, "context", 11, "@ nothing @@"), (1, 4, "delete", -1, "d")]
    assert [(r["hunk_id"], r["old_start"], r["new_start"]) for r in diff.hunks(odd).orderBy("hunk_id").collect()] == [(0, 1, 4), (1, 2, 9)]


def test_components(files):
    d = diff.lines(files)
    imports, exports = diff.import_changes(d), diff.export_changes(d)
    assert {r["module"] for r in diff.dependencies(imports).collect()} == {"lib"}
    assert diff.shared_components(exports, diff.relationships(files, imports)).count() == 0  # './' never resolves
    fixed = diff.shared_components(exports, diff.relationships(files, imports, "fixed")).collect()
    assert [(r["component"], r["used_in"]) for r in fixed] == [("src/b.ts:shared", ["src/c.ts"])]
    assert diff.total_complexity(files, d, imports, exports).first()["complexity"] > 0
    assert diff.coverage(d, d)["unassigned"].count() == 0


def test_ttl(spark):
    log = spark.createDataFrame([(i, "k", t) for i, t in enumerate((0, 50, 61, 110, 122))], "i long, k string, t long")
    assert [r["hit"] for r in state.ttl_hits(log, ["k"], "t", "i", 60).orderBy("i").collect()] == [False, True, False, True, False]
    edge = spark.createDataFrame([(0, "k", 0), (1, "k", 60)], "i long, k string, t long")
    assert [r["hit"] for r in state.ttl_hits(edge, ["k"], "t", "i", 60).orderBy("i").collect()] == [False, True]


def test_lru(spark):
    log = spark.createDataFrame([("c", 0, "set", "a", 5), ("c", 1, "set", "b", 5), ("c", 2, "get", "a", 0), ("c", 3, "set", "d", 5), ("c", 4, "get", "b", 0)], "c string, i long, op string, entry string, size long")
    rows = state.lru(log, "c", "i", 10).orderBy("i").collect()
    assert [(r["hit"], r["evicted"], r["used"]) for r in rows] == [(False, 0, 5), (False, 0, 10), (True, 0, 10), (False, 1, 10), (False, 0, 10)]


def test_ranks(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)] + [("b", float(x)) for x in range(1, 21)], "k string, x double")
    got = {r["k"]: (r["m"], r["p"]) for r in ordered.value_at_rank(rows, ["k"], "x", {"m": 0.5, "p": 0.95}).collect()}
    assert got == {"a": (3.0, 4.0), "b": (11.0, 20.0)}
    run = ordered.running(spark.range(100), F.col("id"), [F.col("id")], F.floor(F.col("id") / 7)).collect()
    assert all(r["running"] == r["id"] * (r["id"] + 1) // 2 for r in run)


@pytest.mark.parametrize(("nodes", "want"), [([(0, 1, "medium", 0.9)] * 3, "needs-discussion"), ([(0, 0, "high", 0.9)], "request-changes"), ([(0, 1, "low", 0.9)], "approve")])
def test_recommendation(spark, nodes, want):
    df = spark.createDataFrame([("r", *n) for n in nodes], "review string, critical int, major int, risk_level string, confidence double")
    assert review.recommend(df, ["review"]).first()["recommendation"] == want


def test_upsert_and_overlap(spark):
    base, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert {(r["k"], r["v"], r["action"]) for r in relational.upsert(base, new, ["k"]).collect()} == {(1, "a", "keep"), (2, "B", "update"), (3, "C", "insert")}
    import random

    rng = random.Random(3)
    sets = [(i, sorted(rng.sample(range(12), rng.randint(1, 8)))) for i in range(60)]
    found = {(r["a"], r["b"]) for r in relational.overlap_pairs(spark.createDataFrame(sets, "k int, s array<int>"), "k", "s", 0.6).collect()}
    assert found == {(a, b) for a, x in sets for b, y in sets if a < b and len({*x} & {*y}) / len({*x} | {*y}) >= 0.6}


def test_tree(spark):
    nodes = spark.createDataFrame([("a", None, 1), ("b", "a", 1), ("c", "a", 2), ("d", "c", 1)], "id string, parent_id string, ordinal int")
    assert {r["id"]: r["path"] for r in tree.levels(nodes).collect()} == {"a": "1", "b": "1.1", "c": "1.2", "d": "1.2.1"}
    roots = spark.createDataFrame([("r", "root")], "id string, name string")
    plan = spark.createDataFrame([("r", True, [("x", "one"), ("y", "two")]), ("x", False, [])], "id string, should_expand boolean, children array<struct<id: string, name: string>>")
    assert {(r["id"], r["depth"], r["is_expanded"]) for r in tree.expand(roots, plan).collect()} == {("r", 0, True), ("x", 1, False), ("y", 1, False)}
    loop = spark.createDataFrame([("a", None, 1), ("b", "c", 1), ("c", "b", 1)], "id string, parent_id string, ordinal int")
    assert tree.levels(loop).count() == 1


def test_deep_tree(spark):
    """No limit of depth; a cycle that a root leads to is an error."""
    chain = [(str(i), None if i == 0 else str(i - 1), 1) for i in range(40)]
    deep = spark.createDataFrame(chain, "id string, parent_id string, ordinal int")
    assert {(r["id"], r["depth"]) for r in tree.levels(deep).collect()} == {(str(i), i) for i in range(40)}
    roots = spark.createDataFrame([("0", "0")], "id string, name string")
    shape = "id string, should_expand boolean, children array<struct<id: string, name: string>>"
    for n in (15, 16, 35):
        plan = spark.createDataFrame([(str(i), True, [(str(i + 1), "x")]) for i in range(n)], shape)
        assert {(r["id"], r["depth"]) for r in tree.expand(roots, plan).collect()} == {(str(i), i) for i in range(n + 1)}
    with pytest.raises(ValueError, match="cycle"):
        tree.expand(roots, spark.createDataFrame([("0", True, [("0", "again")])], shape))
    with pytest.raises(ValueError, match="cycle"):
        tree.levels(spark.createDataFrame([("a", None, 1), ("b", "a", 1), ("b", "c", 1), ("c", "b", 1)], "id string, parent_id string, ordinal int"))


def test_shares_of_nothing(spark):
    """A total of 0 gives NaN, and that is no bottleneck."""
    spans = spark.createDataFrame([("p", 0), ("p", 0), ("q", 3), ("q", 1)], "parent string, ms int")
    got = [(r["parent"], str(r["share"]), r["bottleneck"]) for r in metrics.stage_shares(spans, "parent", "ms").collect()]
    assert sorted(got) == [("p", "nan", False), ("p", "nan", False), ("q", "0.25", False), ("q", "0.75", True)]
    shares = spans.select(ordered.share_of_parent(spans, ["parent"], "ms").alias("s")).collect()
    assert sorted(str(r["s"]) for r in shares) == ["0.25", "0.75", "nan", "nan"]


def test_crossref(spark):
    refs = spark.createDataFrame([("a", "b", "uses", "", True, 0), ("a", "b", "uses", "", True, 1), ("a", "c", "modifies", "", True, 2)], "src string, dst string, relationship string, context string, bidirectional boolean, ord int")
    best = crossref.optimised(refs, 1).collect()
    assert [(r["dst"], r["relationship"]) for r in best] == [("c", "modifies")]
    assert crossref.both_ways(refs.where("ord = 2")).where("relationship = 'modified-by'").count() == 1


def test_best_references_are_dealt_once(spark):
    """One shuffle for both steps and both directions."""
    refs = spark.createDataFrame([("a", x, "uses", "", True, i) for i, x in enumerate("bbcd")], "src string, dst string, relationship string, context string, bidirectional boolean, ord int")
    both = crossref.both_ways(crossref.optimised(refs, 2))
    assert both._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert sorted((r["src"], r["dst"], r["relationship"]) for r in both.collect()) == [("a", "b", "uses"), ("a", "c", "uses"), ("b", "a", "used-by"), ("c", "a", "used-by")]


def test_render(spark):
    where = ("src/a.ts", "f", "C", 3, "x()")
    rows = [("r", 0, "n0", "Login", "business-feature", "high", 0.95, [("critical", "bug", "broken", "mend it", where)], ["tidy"], [], 1, 0)]
    schema = "review_id string, ord int, node_id string, node_name string, node_type string, risk_level string, confidence double, issues array<struct<severity: string, category: string, description: string, suggested_fix: string, location: struct<file_path: string, function_name: string, class_name: string, line_number: int, code_snippet: string>>>, strengths array<string>, test_recommendations array<string>, critical int, major int"
    nodes = spark.createDataFrame(rows, schema)
    text = render.main_comment(nodes, F.lit("request-changes"), F.lit("sum")).first()["comment"]
    assert "1 Critical Issue(s)" in text and "95.0%" in text
    detail = render.node_detail(nodes).first()["comment"]
    assert "C.f()" in detail and "(line 3)" in detail and "- tidy" in detail


def test_sources(spark, tmp_path):
    (tmp_path / "ns.txt").write_text("M\tsrc/a.ts\nR100\tsrc/b.ts\tsrc/c.ts\nA\tREADME.md\n")
    assert [(r["filename"], r["status"]) for r in readers.name_status(spark, str(tmp_path / "ns.txt")).collect()] == [("src/a.ts", "modified")]
    assert {r["filename"] for r in readers.name_status(spark, str(tmp_path / "ns.txt"), "fixed").collect()} == {"src/a.ts", "src/c.ts"}
    answers = spark.createDataFrame([("s", "k1", 1, 'x {"ok": true} y'), ("s", "k2", 1, "{}")], "context string, key string, attempt int, response string")
    rows = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "k string")
    got = readers.decided(rows, answers, "s", F.col("k"), "struct<ok: boolean>", ["ok"], F.struct(F.lit(False).alias("ok")))
    assert {r["k"]: r["decision"]["ok"] for r in got.collect()} == {"k1": True, "k2": False, "k3": False}
    early = spark.createDataFrame([(0, "a.ts", "added", "p1"), (1, "b.ts", "added", "p2")], "ord long, filename string, status string, patch string")
    late = spark.createDataFrame([(0, "a.ts", "modified", "p3")], "ord long, filename string, status string, patch string")
    merged = {r["filename"]: (r["status"], r["patch"]) for r in readers.uncommitted(early, late, late.limit(0)).collect()}
    assert merged == {"a.ts": ("added", "p1\np3"), "b.ts": ("added", "p2")}
