"""Every registered query of the library against the SQL that states it, on the smallest tables."""

import decimal

import duckdb
import pytest

from tarn.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, dict):
        return str(sorted((k, plain(x)) for k, x in v.items()))
    return str(v)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, sf, duck, name):
    df = queries.queries()[name](spark, sf)
    rows = df.collect()
    want = duck.execute(queries.oracle_sql()[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted([plain(r[c]) for c in sorted(names)] for r in rows) == sorted([plain(r[names.index(c)]) for c in sorted(names)] for r in want.fetchall())


def test_queries_without_sql_are_tested_elsewhere():
    brute = {"fuzzy_scores", "fuzzy_supplement", "masked_names", "mention_join", "negated_terms", "quota_classes", "rate_window", "seeded_sample", "sentence_chunks", "text_keys"}
    assert set(queries.queries()) - set(queries.oracle_sql()) == brute
