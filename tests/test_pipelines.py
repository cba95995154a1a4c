"""Composed pipelines on literal frames."""

from pyspark.sql import functions as F

from weftline.functions import jsonx
from weftline.plans import pipelines

THEME = "ord long, id string, name string, description string, affected_files array<string>, code_snippets array<string>, confidence double, context string, functions array<string>, classes array<string>"


def test_consolidation(spark):
    theme = lambda i, name, files: (i, f"t{i}", name, "d", files, [], 0.5 + i / 10, "c", [f"f{i}"], [])
    themes = spark.createDataFrame([theme(0, "Fix login bug", ["a.ts"]), theme(1, "Fix login bugs", ["a.ts", "b.ts"]), theme(2, "Fix login form", ["c.ts"]), theme(3, "Render charts", ["d.ts"])], THEME)
    key = lambda a, b: "-".join(sorted((a, b)))
    yes = '{"shouldMerge": true, "confidence": 0.9, "reasoning": ""}'
    decisions = spark.createDataFrame([("similarity-analysis", key("t0", "t1"), 1, yes), ("similarity-analysis", key("t1", "t2"), 1, yes)], "context string, key string, attempt int, response string")
    nodes = {r["id"]: r for r in pipelines.consolidate(themes, decisions).collect()}
    # leader clustering: t0 takes t1; t2 is similar to t1 only, so it stays alone
    assert nodes["theme-0"]["affected_files"] == ["a.ts", "b.ts"] and nodes["theme-0"]["method"] == "merge"
    assert "theme-1" not in nodes and nodes["theme-2"]["method"] == "single"
    parents = [r for r in nodes.values() if r["method"] == "hierarchy"]
    assert len(parents) == 1 and nodes["theme-0"]["parent_id"] == nodes["theme-2"]["parent_id"] == parents[0]["id"]
    assert nodes["theme-3"]["parent_id"] is None


def test_code_changes(spark):
    files = spark.createDataFrame([(0, "src/a.ts", "removed", "p"), (1, "src/b.test.py", "added", "q")], "ord int, filename string, status string, patch string")
    key = jsonx.content_key(F.col("filename"), F.col("patch"))
    known = files.where("ord = 0").select(F.lit("code-analysis").alias("context"), key.alias("key"), F.lit(1).alias("attempt"), F.lit('{"functionsChanged": ["f"], "classesChanged": [], "importsChanged": [], "fileType": ".ts", "codeComplexity": "high"}').alias("response"))
    rows = pipelines.code_changes(files, known, key).orderBy("ord").collect()
    assert (rows[0]["change_type"], rows[0]["functions_changed"], rows[0]["code_complexity"]) == ("deleted", ["f"], "high")
    assert (rows[1]["file_type"], rows[1]["is_test"], rows[1]["functions_changed"]) == (".py", True, [])
    facts, lists = pipelines.smart_context(pipelines.code_changes(files, known, key))
    assert facts.first()["code_complexity"] == "high" and lists.first()["new_functions"] == []


def test_review(spark):
    nodes = spark.createDataFrame([("r", "n1", 0, "medium", 0.9), ("r", "n2", 1, "low", 0.4)], "review_id string, node_id string, ord int, risk_level string, confidence double")
    issues = spark.createDataFrame([("n2", 0, "major"), ("n1", 0, "minor"), ("n1", 1, "critical")], "node_id string, ord int, severity string")
    out = pipelines.review_result(nodes, issues)
    assert out["recommendation"].first()["recommendation"] == "request-changes"
    assert [(r["node_id"], r["severity"]) for r in out["action_items"].orderBy("rank").collect()] == [("n1", "critical"), ("n2", "major")]


def test_streaming_ttl(spark, tmp_path):
    from weftline.streaming import caches

    rows = spark.createDataFrame([("k", 1_000_000 + t) for t in (0, 50, 61, 110, 122)], "key string, s long").select("key", F.timestamp_seconds("s").alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "in"))
    query = caches.ttl_hits(source, "key", 60).writeStream.format("memory").queryName("ttl").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = [(r["ts"].timestamp(), r["hit"]) for r in spark.table("ttl").orderBy("ts").collect()]
    assert [h for _, h in got] == [False, True, False, True, False], got
