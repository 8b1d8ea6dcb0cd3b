"""The package's queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from lodestrata.llm import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df, want = registry.queries()[name](spark, FOLDER), db.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    rows = lambda names, found: sorted(repr([r[names.index(c)] for c in columns]) for r in found)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_ten_queries_are_registered():
    assert {int(n[2:].split("_")[0]) for n in registry.queries()} == set(range(1, 11))
