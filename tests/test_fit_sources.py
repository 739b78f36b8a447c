"""Fits compute their training table once, however often they pass over it."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from airlake.operators import models


@pytest.mark.parametrize("fit", [
    lambda t: models.fit_predict(t, "gbt", 3, stale=2), lambda t: models.fit_predict(t, "rf", 3), models.fit_classifier, lambda t: models.fit_log_target(t, 3),
    lambda t: models.run_grid(t.drop("features", "fold", "split"), ["station_id", "week_start"], ["spacetime"], {"rf": 2}, ["random", "spatial"], [0, 1], k=2),
], ids=["gbt", "rf", "classifier", "log_target", "grid"])
def test_sources_are_read_once(spark, fit):
    seen = spark.sparkContext.accumulator(0)

    def counted(v):
        seen.add(1)
        return v

    rows = [(f"s{s}", date(2022, 1, 3) + timedelta(7 * w), 10.0 + 3 * s + w % 5, [1.0, 2.0], 30.0 + s, -100.0, w + 1, [float(s), float(w)], 0, "test" if s == 0 else "train") for s in range(6) for w in range(10)]
    table = spark.createDataFrame(rows, "station_id string, week_start date, pm25 double, embedding array<double>, lat double, lon double, week_of_year int, features array<double>, fold int, split string")
    table = table.withColumn("pm25", F.udf(counted, "double").asNondeterministic()("pm25"))
    assert fit(table).count() > 0 and seen.value == len(rows)
