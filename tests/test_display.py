"""One digit after the point, by the exact binary value."""

from __future__ import annotations

import decimal

import duckdb

from wayfold.functions import display


def test_one_decimal(spark):
    from pyspark.sql import functions as F

    values = [1.15, 0.25, 0.35, 2.5, 3.45, 1.05, 0.05, 9.95, 1.0, 0.0, 99.95, 0.15, 0.75, 4.349999999999999, 2.65, *[i / 100 for i in range(500)], *[i / 20 for i in range(100)]]
    expected = []
    for v in values:
        n = (decimal.Decimal(v) * 10).quantize(decimal.Decimal(1), rounding=decimal.ROUND_HALF_UP)
        expected.append(f"{n // 10}.{n % 10}")
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    assert [r.s for r in rows.select("i", display.one_decimal(F.col("v")).alias("s")).orderBy("i").collect()] == expected
    assert rows.limit(1).select(display.one_decimal(F.lit(-1.25)).alias("s")).first().s == "-1.3"
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [[i, v] for i, v in enumerate(values)])
    assert [r[0] for r in con.execute(f"SELECT {display.one_decimal_sql('v')} FROM t ORDER BY i").fetchall()] == expected
