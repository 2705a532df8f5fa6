"""The case queries give the rows of their SQL."""

from __future__ import annotations

import pytest

from auditloom.plans import case_queries, site_case_queries

QUERIES = {**case_queries.QUERIES, **site_case_queries.QUERIES}
SQL = {**case_queries.SQL, **site_case_queries.SQL}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_case_query(spark, name):
    import duckdb

    df = QUERIES[name](spark, "")
    want = duckdb.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(repr, map(tuple, df.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))
