import datetime

import duckdb
import pytest

from marginalia.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    return float(value) if isinstance(value, float) else str(value) if isinstance(value, datetime.datetime) else value


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = catalog.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    expected = sorted(repr([plain(dict(zip(columns, r, strict=True))[c]) for c in sorted(columns)]) for r in want.fetchall())
    assert sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in got.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, SF).collect() is not None
