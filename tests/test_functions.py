"""Literal edge cases with expected values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import code, jsonx
from weftline.functions import predicates as pred
from weftline.functions import similarity as sim
from weftline.functions import text as tx
from weftline.operators import metrics, relational

L = F.lit


@pytest.mark.parametrize(("a", "b", "want"), [("add add add", "add", 3.0), ("add", "add add add", 1.0), ("", "", 1.0)])
def test_name_similarity(value, a, b, want):
    assert value(sim.word_similarity(L(a), L(b))) == want


def test_similarities(value):
    empty = F.array().cast("array<string>")
    assert value(sim.jaccard(empty, empty)) == 0.0
    assert value(sim.jaccard(F.array(L("a"), L("b")), F.array(L("b"), L("c")))) == pytest.approx(1 / 3)
    assert value(sim.description_score(L("fix login bug"), L("fix bug"))) == pytest.approx(2 / 3)
    assert value(sim.key_similarity(L(""), L(""))) == 1.0
    assert value(sim.pair_score(L(False), L(0.9))) == pytest.approx(0.03)
    assert value(sim.word_similarity(L("add add add"), L("add"), "fixed")) == 1.0


@pytest.mark.parametrize(("path", "keep"), [("src/a.ts", True), ("src/a.d.ts", False), ("config.json", False), ("lib/dist/x.js", True), ("dist/x.js", False)])
def test_exclusion(value, path, keep):
    assert value(pred.included(L(path))) is keep


def test_classes(value):
    assert value(pred.business_domain(L("Fix"), L("auth test"))) == "Development Workflow Optimization"
    assert value(pred.file_type(L(".bashrc"))) == "unknown"
    assert value(pred.language(L("a/b.PY"))) == "Python"
    assert value(pred.diff_file_kind(L("src/x.test.ts"))) == "test"
    assert value(pred.valid_domain_name(L("Fix Login Flow"))) is True
    assert value(pred.valid_domain_name(L("The login"))) is False


def test_text(value):
    assert value(tx.word_limit(L("a  b c"), 3)) == "a  b c"
    assert value(tx.word_limit(L("a  b c"), 2)) == "a b"
    assert value(tx.truncated(L("x" * 201))) == "x" * 197 + "..."
    assert value(tx.domain_phrase(L("We should fix login flow."))) == "Fix Login"
    assert value(tx.retryable(L("Request timeout: json"))) is True
    assert value(tx.retryable(L("bad JSON"))) is False
    assert value(tx.fallback_domain(L("src/auth/a.test.ts")))["domain"] == "Development Workflow Optimization"


@pytest.mark.parametrize(("n", "want"), [(3, 1), (10, 4), (28, 4), (100, 10), (1000, 100)])
def test_batch_size(value, n, want):
    assert value(relational.pair_batch_size(L(n))) == want


@pytest.mark.parametrize(("x", "want"), [(0.2, "0.2-0.4"), (0.6, "0.6-0.8"), (0.8, "0.8-1.0"), (1.0, "0.8-1.0")])
def test_buckets(value, x, want):
    assert value(metrics.score_bucket(L(x))) == want


def test_variance(value):
    one = [L(1.0), L(0.0), L(1.0), L(0.0)]
    assert value(metrics.population_variance(*one)) == 0.25
    assert value(metrics.needs_check(*one)) is True
    assert value(metrics.needs_check(*[L(0.5)] * 4)) is False


def test_code(value):
    got = value(code.import_of(L("import React, { useState } from 'react'")))
    assert (got["module"], got["items"]) == ("react", ["useState", "React"])
    assert value(code.import_of(L("import * as fs from 'fs'")))["items"] == ["* as * as fs"]
    assert value(code.resolve_import(L("src/a.ts"), L("./b"))) == "src/./b"
    assert value(code.resolve_import(L("src/a.ts"), L("./b"), "fixed")) == "src/b.ts"
    assert value(code.resolve_import(L("/".join("abcdefghijkl") + "/x.ts"), L("../" * 11 + "b"), "fixed")) == "a/b.ts"
    assert value(code.resolve_import(L("src/a.ts"), L("../../.././b/../c.js"), "fixed")) == "../../c.js"
    assert value(code.resolve_import(L("a.ts"), L("./b"), "fixed")) == "b.ts"
    assert value(code.tested_file(L("src/a.test.ts"))) == "src/a.ts"
    assert value(code.export_of(L("export default class Foo")))["name"] == "class"
    assert value(code.export_of(L("export const bar = 1")))["name"] == "bar"


def test_json(spark):
    texts = ["{\"a\":1}", "```json\n{bad\n```\n{\"a\":1}", "Sure: {\"a\":1} done", "{\"a\":1} and {\"b\":2}", "none", "```\n[1]\n```", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", jsonx.extract_json(F.col("t")).alias("j")).orderBy("i").collect()
    assert [r["j"] for r in rows] == ["{\"a\":1}", None, "{\"a\":1}", "{\"a\":1}", None, "[1]", None]
