"""Distributed selection against numpy, and the operators that use it."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from airlake.operators import labels, metrics, selection


def test_doubles_keep_their_order(spark):
    rng = random.Random(1)
    edges = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, math.nextafter(2.2250738585072014e-308, 0), 1.7976931348623157e308, math.inf, -math.inf]
    powers = [math.ldexp(1, k) for k in range(-1074, 1024, 11)]
    below = [math.nextafter(p, 0) for p in powers]
    any_bits = [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(2000)]
    values = edges + powers + below + [v for v in any_bits if v == v]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", selection.sortable("v").alias("k")).collect()
    for r in rows:
        bits = struct.unpack("<q", struct.pack("<d", abs(r["v"])))[0]
        assert r["k"] == (-bits if r["v"] < 0 else bits)
    odd = spark.createDataFrame([(None,), (math.nan,)], "v double").select(selection.sortable("v")).collect()
    assert [r[0] for r in odd] == [None, None]


def mixed(n=1500):
    """One value in 90 % of a group's rows, values of all sizes, nulls, NaN, a null group, a group without values."""
    rng = random.Random(2)
    rows = [("z", None), ("z", math.nan), ("one", 3.0), ("two", 1.0), ("two", 2.0)]
    for g in ("a", "hot", None):
        for _ in range(n):
            x = 2.5 if g == "hot" and rng.random() < 0.9 else rng.gauss(0, 1) * 10.0 ** rng.randint(-3, 3)
            rows.append((g, x if rng.random() > 0.05 else rng.choice([None, math.nan])))
    return rows


def test_quantiles_are_exact(spark):
    rows = mixed()
    frame = spark.createDataFrame(rows, "g string, x double").repartition(5)
    shares = {"low": 0.0, "mid": 0.5, "high": 0.95, "top": 1.0}
    got = {r["g"]: r for r in selection.quantiles(frame, "x", shares, ["g"]).collect()}
    assert set(got) == {"z", "one", "two", "a", "hot", None}
    for g, row in got.items():
        kept = [x for k, x in rows if k == g and x is not None and x == x]
        for name, share in shares.items():
            assert row[name] is None if not kept else row[name] == pytest.approx(np.quantile(kept, share), rel=1e-12)
    assert got["hot"]["mid"] == 2.5
    assert selection.quantiles(frame.where("false"), "x", shares, ["g"]).count() == 0
    assert selection.quantiles(frame.where("false"), "x", shares).collect() == [(None,) * 4]


def test_summary_and_hit_rates_use_no_percentile(spark):
    rows = [(g or "null", x) for g, x in mixed(300)]
    frame = spark.createDataFrame(rows, "fold string, pm25 double")
    kept = [x for _, x in rows if x is not None and x == x]
    summary = labels.label_summary(frame)
    assert summary.columns == ["median", "p95", "max"]
    assert summary.first()[:] == pytest.approx((np.median(kept), np.quantile(kept, 0.95), max(kept)))
    preds = frame.where("pm25 IS NOT NULL AND NOT isnan(pm25)").withColumn("y_true", F.lit(0.0)).withColumnRenamed("pm25", "y_pred")
    rates = metrics.hit_rates(preds, ["fold"])
    for r in rates.collect():
        errors = [abs(x) for g, x in rows if g == r["fold"] and x is not None and x == x]
        assert r["median_abs_error"] == pytest.approx(np.median(errors)) and r["within_3"] == pytest.approx(np.mean([e <= 3 for e in errors]))
    assert metrics.hit_rates(preds).first()["median_abs_error"] == pytest.approx(np.median([abs(x) for x in kept]))
    for plan in (summary, rates):
        text = plan._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "percentile" not in text and "median(" not in text
