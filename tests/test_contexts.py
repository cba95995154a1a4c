"""Pull request contexts and target branches as rows."""

import json

from weftline.sources import readers


def pull(number, branch, state="open", body="text"):
    return {"number": number, "title": f"t{number}", "body": body, "state": state, "base": {"ref": "main", "sha": f"b{number}"}, "head": {"ref": branch, "sha": f"h{number}"}, "extra": 1}


def test_review_contexts(spark, tmp_path):
    (tmp_path / "p.json").write_text("\n".join(json.dumps(x) for x in (pull(1, "one"), pull(2, "two", "closed"), pull(3, "two", body=None), pull(4, "two"))))
    requests = readers.pull_requests(spark, str(tmp_path / "p.json"))
    runs = [("event", "pull_request", 1, None, None, "x"), ("manual", "manual", 2, "B", "H", None), ("unknown", "manual", 9, "B", "H", None), ("half", "manual", 9, "B", "", "two"), ("branch", "push", None, None, None, "two"), ("none", "push", None, None, None, "gone")]
    found = {r["run"]: tuple(r)[1:] for r in readers.review_contexts(spark.createDataFrame(runs, "run string, event string, number long, base_sha string, head_sha string, branch string"), requests).collect()}
    assert found == {
        "event": (1, "t1", "text", "main", "one", "b1", "h1"), "manual": (2, "t2", "text", "main", "two", "B", "H"), "unknown": (9, "PR #9", "", "main", "feature-branch", "B", "H"),
        "half": (3, "t3", "", "main", "two", "b3", "h3"), "branch": (3, "t3", "", "main", "two", "b3", "h3"), "none": (None,) * 7,
    }


def test_target_branches(spark):
    runs = spark.createDataFrame([("a", "origin/topic"), ("b", "fork/x/y"), ("c", "origin/t"), ("d", "topic"), ("e", None)], "run string, upstream string")
    branches = spark.createDataFrame([("a", "origin/develop"), ("a", "origin/master"), ("a", "origin/master"), ("b", "fork/main"), ("b", "origin/main"), ("c", "fork/main"), ("d", "topic/main")], "run string, branch string")
    assert {r["run"]: r["target"] for r in readers.target_branches(runs, branches).collect()} == {"a": "origin/master", "b": "fork/main", "c": None, "d": None, "e": None}
