"""Every registered query against its SQL statement on the smallest tables."""

import duckdb
import pytest

from flowspark.catalog import all_queries

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
QUERIES = all_queries()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_equals_sql(spark, sf_dir, duck, name):
    run, sql = QUERIES[name]
    df = run(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in place) for r in cursor.fetchall()), key=repr)
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if not sql])
def test_gives_rows(spark, sf_dir, name):
    assert len(QUERIES[name][0](spark, sf_dir).collect()) > 0
