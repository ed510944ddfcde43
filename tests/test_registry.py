"""Registered queries against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from vellumine.plans import registry

DATA = "/root/testdata/sf0.001"
NAMES = sorted(registry.ORACLE_SQL)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "lineitem", "events", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = registry.QUERIES[name](spark, DATA).toPandas()
    want = con.sql(registry.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    plain = lambda v: None if pd.isna(v) else float(v) if isinstance(v, float) or hasattr(v, "item") else v
    rows = lambda d: sorted(map(repr, (tuple(map(plain, r)) for r in d[cols].itertuples(index=False))))
    assert rows(got) == rows(want)


def test_queries_without_sql_are_those_tested_by_brute_force():
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == {"ts_reassign_choose", "qtex_tetranscripts", "qtex_telescope", "qtex_softmax"}
