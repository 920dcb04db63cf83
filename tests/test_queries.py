"""Every registered query with SQL equals it on the small tables; the others give rows with a stable schema."""
import os

import pandas as pd
import pytest

from postern import registry

DIR = os.environ.get("POSTERN_TEST_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DIR}/{name}.parquet')")
    return connection


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if not isinstance(value, (list, tuple, dict)) and pd.isna(value):
        return "~"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return repr(round(float(value), 8))
    return str(value)


def rows(frame, columns):
    return sorted(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    ours = registry.QUERIES[name](spark, DIR)
    frame = ours.toPandas()
    assert len(set(ours.columns)) == len(ours.columns)
    if name in registry.ORACLE:
        want = duck.execute(registry.ORACLE[name]).df()
        assert sorted(want.columns) == sorted(ours.columns)
        assert rows(frame, sorted(ours.columns)) == rows(want, sorted(ours.columns))


def test_flagship(spark):
    assert registry.FLAGSHIP(spark, DIR).count() >= 0
