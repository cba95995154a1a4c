"""The jobs over growing input: two runs, repeated runs, repeated batches, and the command line."""

from __future__ import annotations

import datetime as dt
import json
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import call_ledger, queries, text_intake

TEXTS = "doc_id long, text string, lang string, source string, domain string"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, day string"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plain(value):
    return "NaN" if value != value else value


def rows_of(df):
    return sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)


def by_sql(tmp, sql, **tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.execute(f"create view {name} as select * from read_parquet('{path}/*.parquet')")
    found = con.sql(sql)
    order = [found.columns.index(c) for c in sorted(found.columns)]
    return sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)


def add(spark, rows, schema, path):
    """One more file of rows beside those already there."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


FIRST = [(1, "login form\nfor the user", "en", "src/auth.ts", "x"), (2, None, "en", None, "x"), (3, "import a file, import b file, file c", "de", "a.test.ts", "x"), (4, "login form\nfor the user", None, "src/b.ts", "x")]
SECOND = [(5, "new feature: payment workflow", "en", "pay.ts", "x"), (1, "login form\nfor the user", "en", "src/auth.ts", "x"), (3, "rewritten text", "de", "a.test.ts", "x"), (None, "nameless", "fr", "n.md", "x"), (None, "nameless", "fr", "n.md", "x")]


def test_intake_takes_what_is_new(spark, tmp_path):
    source, output, checkpoint = (str(tmp_path / x) for x in ("docs", "out", "mark"))
    run = lambda: text_intake.run(spark, source, output, checkpoint, files_per_batch=1)
    batches = lambda: {r["batch"]: r["count"] for r in spark.read.schema(text_intake.CATALOGUE).parquet(f"{output}/catalogue").groupBy("batch").count().collect()}
    add(spark, FIRST, TEXTS, source)
    first = rows_of(run())
    assert first == by_sql(tmp_path, queries.INTAKE_SQL, documents=source) and batches() == {0: 4}
    assert rows_of(run()) == first and batches() == {0: 4}  # nothing new: nothing is written
    add(spark, SECOND, TEXTS, source)
    second = rows_of(run())
    assert batches() == {0: 4, 1: 3}  # the row delivered again and the repeated one add nothing
    # as if the current texts had come at once
    whole = str(tmp_path / "whole")
    add(spark, [r for r in FIRST if r[0] != 3] + [r for r in SECOND if r[0] not in (1,)][:-1], TEXTS, whole)
    assert second == by_sql(tmp_path, queries.INTAKE_SQL, documents=whole)
    assert rows_of(text_intake.run(spark, whole, str(tmp_path / "o2"), str(tmp_path / "c2"))) == second


def test_intake_repeats_a_batch_and_a_digest(spark, tmp_path):
    """What a run that failed half-way repeats leaves the same output."""
    source, output = str(tmp_path / "docs"), str(tmp_path / "out")
    add(spark, FIRST + SECOND, TEXTS, source)
    for _ in range(2):
        text_intake.take(spark.read.parquet(source), 0, output)
    text_intake.digest(spark, output)
    once = rows_of(text_intake.result(spark, output))
    spark.read.schema(text_intake.DIGEST).parquet(f"{output}/digest").where("false").write.mode("overwrite").partitionBy("domain").parquet(f"{output}/digest")
    text_intake.digest(spark, output)
    assert rows_of(text_intake.result(spark, output)) == once
    assert sum(r["documents"] for r in spark.read.schema(text_intake.DIGEST).parquet(f"{output}/digest").collect()) == len(once) == 6


def test_intake_of_nothing(spark, tmp_path):
    add(spark, [], TEXTS, tmp_path / "none")
    assert text_intake.run(spark, str(tmp_path / "none"), str(tmp_path / "o"), str(tmp_path / "c")).collect() == []


def event(i, day, hour, user, kind, value):
    return (i, dt.datetime(2024, 1, day, hour, i % 60), user, kind, value, "clash")


CALLS = [event(i, 1 + i // 30, 5 + i % 7, i % 4, ("error", "view", None, "click")[i * i % 7 % 4], (i * 37 % 101) + 0.25) for i in range(80)]
ODD = [(None, dt.datetime(2024, 1, 1), 1, "view", 1.0, ""), (80, None, 1, "view", 1.0, ""), (81, dt.datetime(2024, 1, 1, 23, 59), None, "error", None, ""), (82, dt.datetime(2024, 1, 9), 2, None, 0.0, ""), (83, dt.datetime(2024, 1, 1, 0, 0), None, "error", 5.0, "")]


def test_ledger_takes_what_is_new(spark, tmp_path, monkeypatch):
    source, output, state = (str(tmp_path / x) for x in ("calls", "out", "state"))
    run = lambda: call_ledger.run(spark, source, output, state)
    marks = lambda: sorted((r["mark"], r["rows"], r["days"]) for r in spark.read.parquet(f"{state}/marks").collect())
    add(spark, CALLS[:70], EVENTS, source)
    first = rows_of(run())
    assert first == by_sql(tmp_path, queries.LEDGER_SQL, events=source)
    assert rows_of(run()) == first and marks() == [(69, 70, 3)]
    add(spark, CALLS[70:] + ODD, EVENTS, source)  # new rows fall on old days too
    untouched = {f for f in os.listdir(f"{output}/day=2024-01-02")}
    # the run ends after the output, before the mark: the next one repeats it
    with monkeypatch.context() as broken:
        broken.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            run()
    assert rows_of(run()) == by_sql(tmp_path, queries.LEDGER_SQL, events=source)
    assert marks() == [(69, 70, 3), (83, 13, 3)]
    assert {f for f in os.listdir(f"{output}/day=2024-01-02")} == untouched  # days without new rows are left alone


def test_ledger_marks_bottlenecks_and_streaks(spark):
    rows = [event(i, 1, 1, 1, "error", 100.0) for i in range(4)] + [event(9, 1, 2, 1, "view", 1.0), event(10, 2, 1, 1, "view", 0.0)]
    found = {(str(r["day"]), r["context"]): r for r in call_ledger.ledger(call_ledger.calls_of(spark.createDataFrame(rows, EVENTS))).collect()}
    error, still = found["2024-01-01", "error"], found["2024-01-02", "view"]
    assert (error["calls"], error["total_ms"], error["slowest"], error["slow_calls"], error["bottleneck"], error["error_streaks"], error["longest_streak"]) == (4, 40_000, 0, 4, True, 1, 4)
    assert still["share"] != still["share"] and not still["bottleneck"] and still["longest_streak"] == 0


def test_ledger_of_nothing(spark, tmp_path):
    add(spark, [], EVENTS, tmp_path / "none")
    assert call_ledger.run(spark, str(tmp_path / "none"), str(tmp_path / "o"), str(tmp_path / "s")).collect() == []


def test_command_line(spark, tmp_path):
    """A config file, an argument over it, and a session that the command starts and stops."""
    source = str(tmp_path / "calls")
    add(spark, CALLS, EVENTS, source)
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"source": "", "output": str(tmp_path / "out"), "state": str(tmp_path / "state"), "streak": 2}))
    done = subprocess.run([sys.executable, "jobs/call_ledger.py", "--config", str(config), "--source", source], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "read 80 new rows" in done.stderr, done.stderr
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("calls")).first()[0] == 80
    lacking = subprocess.run([sys.executable, "-m", "jobs.text_intake", "--source", source], cwd=ROOT, capture_output=True, text=True, timeout=100)
    assert lacking.returncode == 2 and "no path for output" in lacking.stderr


def test_texts_are_put_in_lower_case_once(spark):
    """One lower case of a text serves all labels, and patterns wait for their word: same verdicts as a plain search."""
    from weftline.functions import text as texts
    from weftline.functions.base import any_match, led_match

    docs = spark.createDataFrame([(1, "Import a\nLogger", "en", "x")], "doc_id long, text string, lang string, source string")
    plan = text_intake.catalogued(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == plan.count("lower(source") + 2, plan  # the text, and the text with its source; paths are short
    odd = ["", None, "import x logger", "import\nlogger", "x.warn(", "swarn(", "console.error", "console.warn is replaced by logger", "add the import", "update", "renamed variable", "business logic", "user\nflow", "featureflag", "workflows", "auth"]
    rows = spark.createDataFrame([(x,) for x in odd], "t string")
    for patterns in (texts.SIMPLE_CHANGE_WIDE, texts.COMPLEX_CHANGE_WIDE):
        got = rows.select(led_match(F.col("t"), patterns).alias("a"), any_match(F.col("t"), patterns).alias("b")).collect()
        assert [r["a"] for r in got] == [r["b"] for r in got] and {r["a"] for r in got} == {True, False}
