"""Queries against their SQL on rows that the small tables do not hold: larger keys, other white space, equal places."""

from __future__ import annotations

import os

import duckdb
import pytest

from tests.test_oracle import TABLES, rows_of
from wayfold.plans import catalogue


def folder(path, sf_dir, **tables):
    """The tables of sf_dir, some of them replaced by what SQL over the others gives."""
    con = duckdb.connect()
    for t in TABLES:
        at = f"{path}/{t}.parquet"
        if t in tables:
            con.execute(f"COPY ({tables[t].format(own=f"'{sf_dir}/{t}.parquet'")}) TO '{at}' (FORMAT parquet)")
        else:
            os.symlink(f"{sf_dir}/{t}.parquet", at)
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}')")
    return str(path), con


def both(spark, path, con, name):
    """Rows of the query and of its SQL."""
    df, want = catalogue.queries()[name](spark, path), con.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    return rows_of(df.columns, df.collect()), rows_of(columns, want.fetchall())


#: The view puts supplier 5027 at a latitude of 39.0005.
NORTHERN = "SELECT * FROM {own} UNION ALL SELECT 5027, 'Supplier#000005027', 2, 0e0"


@pytest.mark.parametrize("name", ["checked_results", "resolved_places", "placed_texts"])
def test_results_count_wherever_they_lie(spark, sf_dir, tmp_path, name):
    got, want = both(spark, *folder(tmp_path, sf_dir, supplier=NORTHERN), name)
    assert got == want


#: First words that differ by a line break alone.
BROKEN = "SELECT * FROM {own} UNION ALL SELECT 900000 + i, 0, 'user', CASE WHEN i < 2 THEN 'Abc.\nDef x' WHEN i < 4 THEN 'abc.def y' ELSE 'ABC.\nDEF z' END FROM range(6) t(i)"


def test_names_with_line_breaks_stay_apart(spark, sf_dir, tmp_path):
    got, want = both(spark, *folder(tmp_path, sf_dir, conversations=BROKEN), "merged_mentions")
    assert got == want
