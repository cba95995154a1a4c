"""Fingerprints of improbable features against a plain restatement, and their likeness."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from weftline.llm import improbable, queries
from weftline.llm.improbable import LEVELS, LOW, RUN, VOTES, WINDOW, Print

SCHEMA = "doc_id long, text string, fingerprint string, range string"


def plain_levels(text: bytes) -> list[int]:
    most, out = round(WINDOW * math.log2(WINDOW) * 2**20), []
    for i in range(len(text) - WINDOW + 1):
        have = sum(round(c * math.log2(c) * 2**20) for c in Counter(text[i : i + WINDOW]).values())
        out.append((most - have) * LEVELS // most)
    return out


def plain_chosen(text: bytes, ranks) -> list[bytes]:
    """Selected windows of a text in order, each once."""
    level = plain_levels(text)
    runs = max(len(level) - RUN + 1, 1) if level else 0
    votes = Counter()
    for s in range(runs):
        able = [(ranks[level[i]], i) for i in range(s, min(s + RUN, len(level))) if level[i] >= LOW]
        if able:
            votes[min(able)[1]] += 1
    chosen = [text[i : i + WINDOW] for i in sorted(votes) if votes[i] >= min(VOTES, runs)]
    return list(dict.fromkeys(chosen))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    prose = lambda n: " ".join("".join(rng.choice("aeionrstlk") for _ in range(rng.randint(2, 8))) for _ in range(n))
    odd = [None, "", "a", "short text", "x" * 500, "ab" * 40, "x" * 200 + prose(5), "é ß 漢字 " * 30, prose(4), prose(5), prose(6)]
    return odd + [prose(rng.randint(1, 200)) for _ in range(30)] + ["same line of text that comes back\n" * 20] * 2


def test_selection(texts):
    raw = [(t or "").encode() for t in texts]
    counts = improbable.level_counts(raw)
    plain = Counter(v for t in raw for v in plain_levels(t))
    assert counts.tolist() == [plain[i] for i in range(LEVELS + 1)]
    ranks = improbable.ranked(counts)
    assert sorted(ranks) == list(range(LEVELS + 1)) and all(counts[a] <= counts[b] for a, b in zip(np.argsort(ranks), np.argsort(ranks)[1:], strict=False))
    for text, found in zip(raw, improbable.fingerprint(raw, ranks), strict=True):
        want = plain_chosen(text, ranks)
        assert found.sizes.sum() == (len(want) or bool(text))
        assert (found.sizes[:-1] == improbable.CHAIN).all() and str(Print.parse(str(found))) == str(found)
    assert improbable.fingerprint([], ranks) == []


def test_segments_do_not_show(texts, monkeypatch):
    """Bounded segments give what one segment a text gives; a text of 3 MB ends."""
    raw = [(t or "").encode() for t in texts]
    ranks = improbable.ranked(improbable.level_counts(raw))
    whole, counts = [str(p) for p in improbable.fingerprint(raw, ranks)], improbable.level_counts(raw)
    monkeypatch.setattr(improbable, "SEGMENT", 61)
    assert [str(p) for p in improbable.fingerprint(raw, ranks)] == whole
    assert (improbable.level_counts(raw) == counts).all()
    monkeypatch.undo()
    long = random.Random(4).randbytes(3 << 20)
    assert improbable.fingerprint([long], ranks)[0].sizes.sum() > 50_000


def test_likeness(texts):
    rng = random.Random(9)
    raw = [rng.randbytes(n) for n in (2_000, 2_000, 40_000)]
    ranks = improbable.ranked(improbable.level_counts(raw))
    a, b, c, half, part, none = improbable.fingerprint([*raw, raw[0][:1000] + raw[1][:1000], raw[2][5000:15_000], b""], ranks)
    assert improbable.likeness(a, a) == improbable.likeness(none, none) == 1.0
    assert improbable.likeness(a, none) == improbable.likeness(none, a) == 0.0
    assert improbable.likeness(a, b) < 0.05 and improbable.likeness(a, c) < 0.05
    assert 0.35 < improbable.likeness(a, half) < 0.65 and improbable.likeness(a, half) == improbable.likeness(half, a)
    assert improbable.likeness(part, c) > 0.5  # a passage of a long text


def brute(rows, ranks):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    out = []
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        p, e, f = improbable.fingerprint([text.encode(), edited.encode(), following.encode()], np.array(ranks))
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), str(p), str(e), improbable.likeness(p, e), improbable.likeness(p, f)))
    return sorted(out, key=repr)


def result(df, ranks):
    return sorted((tuple(r) for r in improbable.edited_likeness(df, ranks).collect()), key=repr)


def test_neighbours(spark, texts):
    """Every document meets the next one over range borders; null and repeated identifiers, repeated rows, one document, none."""
    rng = random.Random(3)
    rows = [(rng.randrange(-500, 500) * 1000, t) for t in texts] + [(None, "no name"), (None, None), (77, "twice"), (77, "twice"), (77, "thrice")]
    df = spark.createDataFrame([(*r, "f", "r") for r in rows], SCHEMA).repartition(3)
    ranks = improbable.fit(df)
    assert result(df, ranks) == brute(rows, ranks)
    one = spark.createDataFrame([(5, "only one", "f", "r")], SCHEMA)
    assert result(one, ranks) == brute([(5, "only one")], ranks)
    assert result(one.where("doc_id > 5"), improbable.fit(one.where("doc_id > 5"))) == []
    nameless = spark.createDataFrame([(None, "b", "", ""), (None, "a", "", "")], SCHEMA)
    assert result(nameless, ranks) == brute([(None, "a"), (None, "b")], ranks)


def test_query(spark):
    """The registered query over sf0.001: exact columns by brute force, equal texts alike, the edit nearer than the next."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = queries.op12_fingerprints(spark, sf).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute(rows, improbable.fit(docs))
    near = [(r["near_edited"], r["near_next"]) for r in found if r["n_chars"] > 300]
    assert sum(e > n for e, n in near) >= 0.95 * len(near)
    both = improbable.fingerprints(docs, improbable.fit(docs))
    assert both.select(improbable.likeness_of("fingerprint", "fingerprint").alias("x")).distinct().collect()[0]["x"] == 1.0
