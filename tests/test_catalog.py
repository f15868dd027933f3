"""Every catalogue query against its DuckDB text on the smallest data set."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from sparkroll import catalog  # noqa: E402
from tools.check import table  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        connection.execute(f"create view {p.stem} as select * from '{p}'")
    return connection


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    assert not [k for k in QUERIES if "pipeline" in k or k.startswith("op")]


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, con, key):
    df = QUERIES[key](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if key not in ORACLES:
        assert rows
        return
    result = con.execute(ORACLES[key])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert table(df.columns, rows) == table(names, result.fetchall())


def test_entry(spark):
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() == 1
