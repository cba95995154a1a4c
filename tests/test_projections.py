"""Projections between themes, nodes and assignments, and summary lines."""

from pyspark.sql import functions as F

from weftline.functions import assignments
from weftline.operators import projections as proj


def test_theme_to_node_and_back(spark):
    schema = "id string, name string, level int, description string, business_impact string, detailed_description string, files_changed int, affected_files array<string>, parent_id string, confidence double"
    themes = spark.createDataFrame([("a", "A", 1, "d", "b", "", 3, ["x", "y"], "p", 0.5), ("b", "B", 0, "d", None, "more", None, None, None, None)], schema)
    nodes = {r["id"]: r for r in proj.theme_nodes(themes).collect()}
    assert (nodes["a"]["technical_context"], nodes["a"]["complexity"], nodes["a"]["file_count"]) == ("d", "high", 2)
    assert (nodes["b"]["technical_context"], nodes["b"]["complexity"], nodes["b"]["file_count"]) == ("more", "medium", 0)
    back = {r["id"]: r for r in proj.node_themes(proj.theme_nodes(themes)).collect()}
    assert back["a"]["affected_files"] == ["x", "y"] and back["a"]["context"] == "d" and back["a"]["files_changed"] == 2 and back["b"]["source_themes"] == ["b"]


def test_confidence(value):
    of = lambda lines, whole, primary=True, refs=0: round(value(proj.assigned_confidence(F.col("l"), F.col("w"), F.lit(primary), F.lit(refs)), l=lines, w=whole), 6)
    assert (of(5, 10), of(5, 10, refs=1), of(5, 10, False), of(1, 20), of(9, 10), of(0, 0), of(3, 0)) == (0.9, 0.95, 0.8, 0.8, 0.8, 0.9, 0.8)


def test_assignment_nodes(spark):
    hunk = (1, 1, 1, 1, [("add", "x"), ("add", "y")])
    kept = [("n", None, None, "why", [("f", [hunk], None), ("g", [hunk], None), ("f", [hunk], None)], None, None)]
    df = spark.createDataFrame([("p", 1, 10, kept), ("q", 1, 10, [])], f"id string, level int, lines int, a array<{assignments.ASSIGNMENT}>")
    rows = proj.assignment_nodes(df.withColumn("kept", assignments.kept(F.col("a")))).collect()
    assert [(r["id"], r["parent_id"], r["level"], r["affected_files"], r["file_count"], r["lines"], round(r["expansion_confidence"], 6)) for r in rows] == [("p_child_0", "p", 2, ["f", "g"], 2, 6, 0.9)]


def test_summaries(spark):
    columns = "n int, t array<string>, c string, a array<string>, m array<string>, p array<string>, d array<string>, i array<string>"
    df = spark.createDataFrame([(2, ["ts"], "low", ["f1", "f2", "f3", "f4"], [], ["mvc", "dao"], [], ["x", "y", "z"]), (0, [], "low", [], [], [], [], [])], columns)
    lines = [r[0] for r in df.select(proj.context_summary(*[F.col(c) for c in "ntcampdi"])).collect()]
    assert lines == ["2 files changed | Types: ts | New functions: f1, f2, f3... | Patterns: mvc, dao | New imports: x, y... | Complexity: low", "0 files changed | Complexity: low"]
    changes = spark.createDataFrame([(1, "modified", "a", "high", "big"), (2, "added", "b", "high", "new"), (3, "deleted", "c", "low", ""), (4, "modified", "d", "high", None)], "ord int, change_type string, file string, code_complexity string, semantic_description string")
    assert [r["text"] for r in proj.significant_changes(changes).orderBy("kind", "ord").collect()] == ["New file: b", "Deleted file: c", "Complex change: big", "Complex change: new"]


def test_fallback_theme(spark):
    files = spark.createDataFrame([("a.test.ts",), ("src/b.ts",), ("Makefile",)], "filename string")
    row = proj.fallback_theme(files).first()
    assert (row["total_files"], row["file_types"], row["has_tests"], row["has_config"], row["code_complexity"], row["context_summary"]) == (3, ["Makefile", "ts"], True, False, "medium", "Fallback analysis: 3 files changed")
    assert proj.fallback_theme(files.limit(0)).first()["total_files"] == 0
    assert {(r["kind"], r["files"]) for r in proj.files_by_kind(files.withColumn("k", F.lit(1)), ["k"]).collect()} == {("test", 1), ("source", 2)}
