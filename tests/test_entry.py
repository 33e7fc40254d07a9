from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from facetra.plans.registry import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def close(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert sorted(con.sql(SQL[name]).columns) == columns
    want = Counter(tuple(map(close, r)) for r in con.sql(f"SELECT {quoted} FROM ({SQL[name]})").fetchall())
    assert Counter(tuple(map(close, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()) == want
