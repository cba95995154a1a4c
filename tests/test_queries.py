"""Every table query against its DuckDB statement on the smallest tables."""

import os

import duckdb
import pytest

from weftline.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        kind = frame[c].dtype.kind
        frame[c] = frame[c].astype(float) if kind in "iuf" else frame[c].map(lambda x: "null" if x is None or x != x else str(x))
    return sorted(map(tuple, frame.fillna(-1e99).values.tolist()), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLES:
        wanted = duck.execute(catalog.ORACLES[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert canonical(found) == canonical(wanted)
    else:
        assert len(found)


def test_leaders_match_fold(spark):
    """Leader clusters against the sequential fold; both physical forms."""
    import random

    from weftline.operators import cluster

    rng = random.Random(5)
    edges = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)})
    near = {i: set() for i in range(40)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    leader = {}
    for i in range(40):
        if i not in leader:
            leader[i] = i
            for j in sorted(near[i]):
                leader.setdefault(j, i)
    items = spark.createDataFrame([(i,) for i in range(40)], "ord long")
    frame = spark.createDataFrame(edges, "a long, b long")
    assert {r["item"]: r["leader"] for r in cluster.leaders(items, frame, "ord").collect()} == leader
    assert {r["item"]: r["leader"] for r in cluster.leaders(items, frame, "ord", limit=0).collect()} == leader


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
