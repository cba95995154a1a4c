"""Answer schemas, whole diffs and related nodes."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from weftline.functions import answers
from weftline.operators import crossref
from weftline.sources import readers

NAMING = '{"themeName": "Cart", "reasoning": "r"}'


def test_statuses(spark):
    rows = [
        ("theme_naming", NAMING, "valid", []), ("theme_naming", f"well:\n```json\n{NAMING}\n```", "valid", []), ("theme_naming", '{"themeName": 3}', "rejected", [("themeName", "expected string"), ("reasoning", "missing")]),
        ("theme_naming", '{"themeName": "a", "reasoning": null, "alternativeNames": ["x", 1]}', "rejected", [("alternativeNames.1", "expected string"), ("reasoning", "expected string")]),
        ("theme_naming", "nothing", "no-json", [("", "no object")]), ("theme_naming", "[1]", "no-json", [("", "no object")]), ("theme_naming", None, "no-json", [("", "no object")]), ("unknown", NAMING, "no-schema", []), (None, NAMING, "no-schema", []),
        ("batch_similarity", '{"results": [{"pairId": "a", "shouldMerge": true, "confidence": 1, "scores": {"name": 0.5, "description": "x"}}]}', "rejected",
         [("results.0.scores.description", "expected number"), ("results.0.scores.pattern", "missing"), ("results.0.scores.business", "missing"), ("results.0.scores.semantic", "missing")]),
        ("similarity_check", 'no: {"shouldMerge": false, "confidence": 0.2', "refused", []), ("similarity_check", '{"shouldMerge": false, "confidence": 0.9}', "rejected", None),
        ("cross_level_similarity", '{"relationship": "none", "confidence": 0.35, "action": "keep_both", "reasoning": ""}', "valid", []), ("cross_level_similarity", '{"relationship": "NONE"}', "refused", []),
        ("theme_extraction", '{"themeName": "t", "description": "d", "businessImpact": "b", "confidence": 0.5, "codePattern": "c", "detailedDescription": null, "keyChanges": []}', "valid", []),
    ]
    df = spark.createDataFrame([(i, k, t) for i, (k, t, _, _) in enumerate(rows)], "i int, kind string, text string")
    found = df.withColumn("c", answers.checked(F.col("text"), F.col("kind"))).orderBy("i").collect()
    for r, (kind, text, status, issues) in zip(found, rows, strict=True):
        assert r["c"]["status"] == status, (kind, text, r["c"])
        assert issues is None or [tuple(x) for x in r["c"]["issues"]] == issues, (kind, text)
    assert found[10]["c"]["confidence"] == 0.2 and found[13]["c"]["confidence"] == 0.1


def test_parts_and_stand_ins(spark):
    df = spark.createDataFrame([("theme_naming", '{"themeName": "a"}'), ("theme_naming", '{"themeName": 1}'), ("theme_naming", '{"reasoning": "a"}'), ("nobody", '{"themeName": "a"}')], "kind string, text string")
    found = [r["p"] for r in df.select(answers.partly(F.col("text"), F.col("kind"), ["themeName"]).alias("p")).collect()]
    assert [(p["ok"], p["clean"]) for p in found] == [(True, True), (True, False), (False, False), (True, False)] and found[2]["json"] is None
    kinds = spark.createDataFrame([(k, 'a "b"\n.ts') for k in (*answers.SCHEMAS, "nobody")], "kind string, name string")
    stand = kinds.withColumn("f", answers.fallback(F.col("kind"), F.lit("ts"), F.col("name"), F.lit("")))
    for r in stand.withColumn("issues", answers.issues(F.try_parse_json("f"), F.col("kind"))).collect():
        want = dict(answers.FALLBACKS.get(r["kind"], {}))
        want |= {"code_analysis": {"fileType": "ts"}, "theme_extraction": {"themeName": 'Changes in a "b"\n.ts'}}.get(r["kind"], {})
        assert (json.loads(r["f"]) if r["f"] else {}) == want and not r["issues"]


def test_whole_diff(spark, tmp_path):
    """Files of a diff, whether read in one piece or cut over many tasks."""
    parts = [
        "diff --git a/src/a.ts b/src/a.ts\nindex 1..2 100644\n--- a/src/a.ts\n+++ b/src/a.ts\n@@ -1,2 +1,3 @@ function a() {\n keep\n+new diff --git inside\n-old\n@@ -9 +9 @@\n+z",
        "diff --git a/new.md b/new.md\nnew file mode 100644\n--- /dev/null\n+++ b/new.md\n@@ -0,0 +1 @@\n+hello",
        "diff --git a/gone.ts b/gone.ts\ndeleted file mode 100644\n--- a/gone.ts\n+++ /dev/null\n@@ -1 +0,0 @@\n-bye",
        "diff --git a/old name.ts b/new name.ts\nsimilarity index 100%\nrename from old name.ts\nrename to new name.ts", "diff --git a/x.png b/x.png\nBinary files a/x.png and b/x.png differ",
    ]
    many = [f"diff --git a/m{i}.ts b/m{i}.ts\n--- a/m{i}.ts\n+++ b/m{i}.ts\n@@ -1 +1 @@\n-{'x' * i}\n+{'y' * i}" for i in range(400)]
    (tmp_path / "d.diff").write_text("\n".join(parts + many) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = readers.whole_diff(spark, str(tmp_path / "d.diff"))
        assert df.rdd.getNumPartitions() > 5
        rows = {r["filename"]: r for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 405 and all(rows[f"m{i}.ts"]["patch"] == f"@@ -1 +1 @@\n-{'x' * i}\n+{'y' * i}" for i in range(400))
    shape = {n: (r["status"], r["additions"], r["deletions"]) for n, r in rows.items()}
    assert shape["src/a.ts"] == ("modified", 2, 1) and shape["new.md"] == ("added", 1, 0) and shape["gone.ts"] == ("removed", 0, 1) and shape["new name.ts"] == ("renamed", 0, 0) and shape["x.png"] == ("modified", 0, 0)
    assert rows["src/a.ts"]["patch"].count("@@ -") == 2 and rows["x.png"]["patch"] == ""


def test_related_groups_are_the_nested_loop(spark):
    rng = random.Random(7)
    words = lambda n: " ".join(rng.choice(["Ab", "cd", "EF", "gh", "ij", "kl", "mn", "op", "qr"]) for _ in range(n))
    nodes = [(f"n{i}", i, rng.choice([words(3), None, ""]), [f"d{rng.randrange(25)}/f" for _ in range(rng.randint(0, 2))] + (["root"] if i % 11 == 0 else []), rng.choice([words(rng.randint(1, 6)), f"only{i}", None])) for i in range(45)]
    bag = lambda t: set((t or "").lower().split()) or {""}
    dirs = lambda fs: {f.rpartition("/")[0] for f in fs}
    alike = lambda a, b: bool(dirs(a[3]) & dirs(b[3])) or len(bag(a[2]) & bag(b[2])) >= 2 or len(bag(a[4]) & bag(b[4])) / min(len(bag(a[4])), len(bag(b[4]))) > 0.3
    want = {(a[1], b[1]) for a in nodes for b in nodes if a[1] < b[1] and alike(a, b)}
    leader = {}
    for a in nodes:
        if a[1] not in leader:
            leader[a[1]] = a[1]
            for b in nodes:
                if (a[1], b[1]) in want:
                    leader.setdefault(b[1], a[1])
    df = spark.createDataFrame(nodes, "id string, ord long, name string, affected_files array<string>, context string")
    pairs = crossref.related(df)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want
    assert {r["ord"]: r["leader"] for r in crossref.related_groups(df, pairs).collect()} == leader
    links = {(r["src"], r["dst"]) for r in crossref.related_links(df).collect()}
    assert links == {(f"n{x}", f"n{y}") for a, b in want if leader[a] == leader[b] for x, y in ((a, b), (b, a))}


def test_an_answer_given_again_is_checked_once(spark):
    """Copies of an answer, null ones too, share one judgement; the same text of another kind has its own."""
    from weftline.plans import answers as plans

    rows = [("similarity_check", "{}"), ("similarity_check", "{}"), ("other", "{}"), ("other", None), ("other", None), ("similarity_check", None)]
    found = plans._judged(spark.createDataFrame(rows, "kind string, text string")).select("kind", "text", "status").collect()
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, [("similarity_check", "{}", "rejected"), ("other", "{}", "no-schema"), ("other", None, "no-json"), ("similarity_check", None, "no-json")]))
