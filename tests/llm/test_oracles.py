import duckdb
import pytest

from marginalia.llm import entries

from .cases import SF


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    got = entries.queries()[name](spark, SF)
    con = duckdb.connect()
    for table in ("documents", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    want = con.execute(entries.oracle_sql()[name])
    names = sorted(c[0] for c in want.description)
    assert sorted(got.columns) == names
    columns = [c[0] for c in want.description]
    expected = [dict(zip(columns, r, strict=True)) for r in want.fetchall()]
    assert sorted(repr([r[n] for n in names]) for r in got.collect()) == sorted(repr([r[n] for n in names]) for r in expected)


def test_every_operator_has_one_query():
    assert [n.split("_")[0] for n in entries.queries()] == [f"op{k}" for k in range(1, 14)]
