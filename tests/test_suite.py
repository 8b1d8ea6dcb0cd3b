"""Every query of the review engine against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from lodestrata import suite

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in TABLES:
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return db


def _value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) if isinstance(v, float) else v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_value(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(suite.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = suite.queries()[name](spark, FOLDER)
    want = duck.sql(suite.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(want.columns, want.fetchall())


def test_profile_infers_kinds(spark):
    found = {r["col"]: r["kind"] for r in suite.queries()["infer_dtype_profile"](spark, FOLDER).collect()}
    assert found == {"effectiveness": "numeric", "gender": "text", "flag": "boolean", "age": "text"}
