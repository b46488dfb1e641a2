"""The numbered operators that have SQL against it, on the smallest tables."""

import duckdb
import pytest

from tarn.llm import queries
from tests.test_queries import TABLES, plain


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_operator_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    df = queries.queries()[name](spark, sf)
    rows = df.collect()
    want = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted([plain(r[c]) for c in names] for r in rows) == sorted([plain(x) for x in r] for r in want.fetchall())
