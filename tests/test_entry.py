import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from eventloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v + 0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df, rel = catalog.QUERIES[name](spark, SF), duck.sql(catalog.ORACLE_SQL[name])
    columns, there = sorted(df.columns), list(rel.columns)
    assert columns == sorted(there)
    order = [there.index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    assert Counter(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
