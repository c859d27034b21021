"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

from tidewater.evaluation import splits
from tidewater.plans import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return db


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, str(DATA))
    rows = df.collect()
    if name not in registry.ORACLES:
        assert df.columns
        return
    want = duck.sql(registry.ORACLES[name])
    names = sorted(want.columns)
    assert sorted(df.columns) == names
    at = [want.columns.index(n) for n in names]
    got = sorted((tuple(plain(r[n]) for n in names) for r in rows), key=repr)
    assert got == sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=repr)


def test_growing_training_sets_are_summed_on(spark, monkeypatch):
    def assign(*_):
        raise AssertionError("a row for each fold that trains on it")

    monkeypatch.setattr(splits.ExpandingWindowSplit, "assign", assign)
    n = spark.read.parquet(str(DATA / "events.parquet")).count()
    assert registry.QUERIES["split_expanding"](spark, str(DATA)).count() == 2 * ((n - 265) // 150 + 1)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_stands_without_the_corpus_operators():
    top = Path(__file__).resolve().parent.parent / "tidewater"
    for path in top.rglob("*.py"):
        if "llm" not in path.parts:
            assert "tidewater.llm" not in path.read_text()
