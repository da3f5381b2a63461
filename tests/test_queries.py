"""Every registered query on the smallest tables: against its SQL where it has one, for rows otherwise."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import kind, table

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns, got = table(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    expected_columns, expected = table(names, cursor.fetchall())
    assert columns == expected_columns
    assert len(got) == len(expected)
    assert got == expected
    for i, c in enumerate(columns):
        assert {kind(r[i]) for r in got} == {kind(r[i]) for r in expected}, c


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert len(QUERIES[name](spark, FOLDER).collect()) > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
