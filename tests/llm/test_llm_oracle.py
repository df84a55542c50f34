"""The numbered queries that SQL expresses give the rows that DuckDB gives."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from wayfold.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    df = queries.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    assert Counter(map(tuple, df.select(*columns).collect())) == Counter(want.fetchall())
