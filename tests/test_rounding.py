"""Fractions of queries are rounded as the SQL rounds them, with the sign of zero."""

import math

import duckdb

from airlake.plans import queries


def test_rounded_as_sql(spark):
    # Decimal halves whose double lies beside the half, zeros of either sign, numbers that cannot be scaled.
    values = [-1.2345675, 1.2345675, 0.0000015, 0.1234565, 2.0000005, -3e-7, 3e-7, -0.0, 0.0, 1e17, -1e305, 9007199254.740993, math.inf, -math.inf, math.nan]
    values += [(3 * s / 14 / 10000 - 0.456) / 0.224 for s in range(500)]
    duck = duckdb.connect()
    want = [duck.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchall()[0][0] for v in values]
    frame = spark.createDataFrame([(k, v, [v, None]) for k, v in enumerate(values)], "k int, v double, a array<double>")
    rows = queries._rounded(frame).orderBy("k").collect()
    assert [repr(r["v"]) for r in rows] == [repr(v) for v in want]
    assert [repr(r["a"]) for r in rows] == [repr([v, None]) for v in want]


def test_zeros_to_which_sql_adds_are_positive(spark):
    got = queries._rounded(queries._positive_zeros(spark.createDataFrame([([-3e-7, -0.0, -1.5],)], "x array<double>"), "x")).first()["x"]
    assert [repr(v) for v in got] == ["0.0", "0.0", "-1.5"]
