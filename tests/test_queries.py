"""Every query beside its SQL on the smallest tables."""

import math
from pathlib import Path

import pytest

DATA = "/root/testdata/sf0.001"
TABLES = "conversations documents benchmark events embeddings labels".split()

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def sorted_rows(frame):
    frame = frame.astype(object)[sorted(frame.columns)]
    rows = [
        tuple(None if v is None or (isinstance(v, float) and math.isnan(v)) else v for v in row)
        for row in frame.itertuples(index=False, name=None)
    ]
    return list(frame.columns), sorted(rows, key=lambda r: [(v is None, str(type(v)), v) for v in r if v is not None])


@pytest.fixture(scope="module")
def entry():
    import __spark_entry__

    return __spark_entry__


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def names():
    from checks.oracles import ORACLES

    return sorted(ORACLES)


@pytest.mark.parametrize("name", names())
def test_same_as_sql(spark, entry, duck, name):
    got = sorted_rows(entry.queries()[name](spark, DATA).toPandas())
    expected = sorted_rows(duck.execute(entry.oracle_sql()[name]).fetchdf())
    assert got[0] == expected[0]
    assert sorted(map(repr, got[1])) == sorted(map(repr, expected[1]))


def test_flagship(spark, entry):
    assert entry.entry(spark).count() > 0
