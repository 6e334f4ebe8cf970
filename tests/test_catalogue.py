"""Each query of the catalogue against its DuckDB twin on the smallest tables."""

import os

import duckdb
import pytest

from millrace.plans import catalogue, oracle

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted([tuple(repr(r[i] + 0.0) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else str(r[i]) for i in order) for r in data])


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, duck, name):
    found = catalogue.queries()[name](spark, SF)
    wanted = duck.execute(oracle.SQL[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(columns) == sorted(found.columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(columns, wanted.fetchall())


def test_every_query_has_a_twin():
    assert set(catalogue.queries()) == set(oracle.SQL)
