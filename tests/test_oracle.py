"""Every query with an SQL form gives the rows that DuckDB gives."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb
import pytest

from wayfold.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, int) or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(normal(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, duck, sf_dir, name):
    df = catalogue.queries()[name](spark, sf_dir)
    got = df.collect()
    want = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    expected = rows_of(columns, want.fetchall())
    assert rows_of(df.columns, got) == expected


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() >= 0
