"""Decontamination: identifiers, periodic texts, copies in lower case, and recall by kind of change."""

from __future__ import annotations

import random
import time

import pytest

from weftline.llm import decontaminate

DOCS = "doc_id long, text string, item_id string, text_hash string, hash string"
ITEM = "on a long table in the old library lay seven green books about the birds that nest near rivers in spring"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], DOCS)


def items_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_identifiers(spark):
    """A null identifier is no other one, and one identifier on two texts is two documents."""
    rows = [(None, f"before {ITEM} after"), (-1, "a clean text of its own words"), (5, f"{ITEM}"), (5, "clean text under the same number"), (None, "clean as well"), (6, None), (7, "")]
    docs, items = documents(spark, rows), items_of(spark, ITEM, None, "")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, items).collect() if r["doc_id"] is not None) == [(5, 0)]
    assert [r["doc_id"] for r in decontaminate.matches(docs, items).collect()].count(None) == 1
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted((r for r in rows if ITEM not in (r[1] or "")), key=repr)
    assert decontaminate.matches(docs.limit(0), items).collect() == [] and decontaminate.matches(docs, items.limit(0)).collect() == []


@pytest.mark.parametrize("unit", ["same", "one two", "a b c d e f g h i j"])
def test_periodic_texts(spark, unit):
    """An item of repeated words in a text of many more of them is found without m * n arrays."""
    n = len(unit.split())
    docs = documents(spark, [(1, " ".join([unit] * (4000 // n))), (2, f"{unit} with other words that go on and on"), (3, " ".join([unit] * (30 // n + 1)) + " end")])
    items = items_of(spark, " ".join([unit] * (400 // n)))
    began = time.perf_counter()
    found = {r["doc_id"]: (r["n_tokens"], r["exact"]) for r in decontaminate.matches(docs, items).collect()}
    assert found[1] == (400, True) and 2 not in found and found[3][0] >= 30
    assert time.perf_counter() - began < 60


def test_many_contradicting_windows_are_judged_in_time():
    """2,000 windows that all map one slot elsewhere: time linear in their number."""
    found = [{"pos": i, "size": 8, "reps": 1, "slots": [7, i], "d_slots": [i, 1_000_000 + i]} for i in range(2000)]
    began = time.perf_counter()
    line = decontaminate._line(found)
    assert time.perf_counter() - began < 2 and line["n_tokens"] == 8 and not line["exact"]


def prose(rng, n):
    return ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n)]


CHANGES = {
    "verbatim": lambda w, rng: w,
    "lower case": lambda w, rng: [x.lower() for x in w],
    "numbers": lambda w, rng: [str(rng.randint(100, 999)) if x.isdigit() else x for x in w],
    "names": lambda w, rng: [{"Alice": "Carla", "Bob": "Dieter"}.get(x, x) for x in w],
    "word put in": lambda w, rng: [*w[: len(w) // 2], "extra", *w[len(w) // 2 :]],
    "word left out": lambda w, rng: [*w[: len(w) // 2], *w[len(w) // 2 + 1 :]],
}


def test_recall_by_kind_of_change(spark):
    """Items with names and numbers inside other text, changed in each way: at least 0.95 of each kind, and no clean text."""
    rng = random.Random(8)
    items = []
    for _ in range(40):
        w = prose(rng, 26)
        for at, x in ((2, "Alice"), (9, "Bob"), (13, "12"), (19, "Alice"), (23, "48")):
            w[at] = x
        items.append(w)
    rows, kinds = [], list(CHANGES)
    for k, kind in enumerate(kinds):
        rows += [(1000 * k + i, " ".join([*prose(rng, 40), *CHANGES[kind](w, rng), *prose(rng, 40)])) for i, w in enumerate(items)]
    rows += [(90_000 + i, " ".join([*prose(rng, 60), "Alice", "has", "12", *prose(rng, 40)])) for i in range(100)]
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(documents(spark, rows), items_of(spark, *(" ".join(w) for w in items))).collect()}
    for k, kind in enumerate(kinds):
        assert sum((1000 * k + i, i) in found for i in range(40)) >= 38, kind
    assert not [d for d, _ in found if d >= 90_000]
