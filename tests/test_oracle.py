"""Each registered query against its SQL in DuckDB, at the smallest scale."""

import glob
import math
import os

import duckdb
import pytest

from lexgrove.plans.oracle import SQL
from lexgrove.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, bool | str):
        return v
    if isinstance(v, int | float):
        return None if math.isnan(v) else round(float(v), 5)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    order = sorted(frame.columns)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in frame.collect()), key=repr)
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == order
    at = [names.index(c) for c in order]
    assert mine == sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)
