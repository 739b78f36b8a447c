"""Semantics of single operators on hand-made rows."""

from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from airlake.functions import scalars as X
from airlake.operators import clean, dataset, labels, manifest, metrics, models, raster
from airlake.sources import tables

DAILY = "station_id string, date date, pm25 double, obs_percent double, lat double, lon double, site_name string, region string"


def days(spark, rows):
    return spark.createDataFrame([("a", date.fromisoformat(d), float(v), float(o), 34.0, -118.0, "x", "r") for d, v, o in rows], DAILY)


def test_week_rules(spark):
    four = days(spark, [(f"2023-01-0{d}", 10, 100) for d in range(2, 6)])
    assert labels.aggregate_weekly(four).count() == 0 and labels.aggregate_weekly(four, min_days=4).count() == 1
    full = days(spark, [(f"2023-01-0{d}", d, 50 if d < 5 else 100) for d in range(2, 9)])
    assert labels.aggregate_weekly(full, 0).first()[1:] == (date(2023, 1, 2), 5.0, 7)
    assert labels.aggregate_weekly(full, min_days=4).first()["n_days"] == 4
    turn = days(spark, [(d, 10, 100) for d in ("2024-12-30", "2024-12-31", "2025-01-01", "2025-01-02", "2025-01-03")])
    assert labels.aggregate_weekly(turn).first()["week_start"] == date(2024, 12, 30)
    spike = days(spark, [(f"2023-08-{d:02}", v, 100) for d, v in zip(range(7, 14), (12, 15, 250, 300, 180, 20, 14))])
    assert labels.aggregate_weekly(spike).first()["pm25"] > 100


def test_coverage(spark):
    assert spark.range(1).select(labels.expected_weeks([2023, 2024])).first()[0] == 105
    weeks = spark.sql("SELECT explode(sequence(DATE'2023-01-02', DATE'2024-12-30', INTERVAL 7 DAY)) AS week_start")
    ranked = weeks.selectExpr("week_start", "row_number() OVER (ORDER BY week_start) AS k")
    table = ranked.where("k <= 80").selectExpr("'a' AS station_id", "week_start").unionAll(ranked.where("k <= 10").selectExpr("'b'", "week_start"))
    assert {r[0] for r in labels.filter_station_coverage(table, [2023, 2024]).select("station_id").collect()} == {"a"}


def test_codes_and_nulls(spark):
    row = spark.createDataFrame([("6", "37", "12345")], "a string, b string, c string").select(X.station_id("a", "b", "c")).first()
    assert row[0] == "06-037-12345"
    raw = spark.createDataFrame([(1, None), (2, "Excluded"), (3, "Included")], "k int, event_type string")
    assert [r.k for r in clean.drop_excluded(raw).orderBy("k").collect()] == [1, 3]
    assert spark.createDataFrame([(None,), (-1.0,)], "v double").select(X.clip_lower("v")).collect() == [(None,), (0.0,)]


def test_hourly_null_hides_higher_poc(spark):
    raw = spark.createDataFrame([("1", "1", "1", p, "2024-01-01", "05:00", v, i) for i, (p, v) in enumerate([(1, None), (2, 5.0)])],
                                "state_code string, county_code string, site_num string, poc int, date_gmt string, time_gmt string, sample_measurement double, seq int")
    regions = tables.regions_df(spark, [("r", "1")])
    assert clean.clean_hourly(raw, regions).count() == 0
    assert clean.clean_hourly(raw.where("poc = 2"), regions).first()["ts"] == datetime(2024, 1, 1, 5)


def test_pass_at_midnight_edge(spark):
    hourly = spark.createDataFrame([("a", datetime(2024, 1, 1, h), float(h)) for h in (21, 22, 23)] + [("a", datetime(2024, 1, 2, 0), 99.0)], "station_id string, ts timestamp_ntz, pm25 double")
    passes = spark.createDataFrame([("a", datetime(2024, 1, 1, 23, 50)), ("a", datetime(2024, 1, 1, 23, 55))], "station_id string, ts timestamp_ntz")
    row = labels.overpass_hour_labels(hourly, passes).first()
    assert (row["pm25"], row["n_hours"]) == (22.5, 2)


def test_keep_precedence(spark):
    rows = [(0.1, 10.0, 1, 0.9), (0.9, 10.0, 1, 0.9), (None, 10.0, 2, 0.9), (1.0, 1.0, 2, 0.0), (1.0, 9.0, 2, 0.0)]
    frame = spark.createDataFrame(rows, "valid_fraction double, pm25 double, n_hours int, zero_frac double")
    assert [r.reason for r in clean.scene_keep(frame).collect()] == ["cloud_low_label", "single_hour_label", "tile_edge_zeros", "pm_below_2.5", ""]


def test_utm_and_grid(spark):
    frame = spark.createDataFrame([("a", 34.05, -118.25)], "station_id string, lat double, lon double")
    east, north = X.to_utm("lat", "lon", X.utm_epsg("lon"))
    row = frame.select(X.utm_epsg("lon"), east, north).first()
    assert row[0] == 32611 and row[1:] == pytest.approx((384629.445, 3768404.621), abs=0.002)
    grid = raster.patch_grid(frame).first()
    assert grid["x0"] % 10 == 0 and abs(grid["x0"] + 1120 - row[1]) <= 10 and abs(grid["y0"] - 1120 - row[2]) <= 10


def test_manifest_resume(spark):
    schema = "station_id string, week_start date, product string, status string, ingest_seq long, bands string, mode string"
    d = date(2024, 1, 1)
    old = spark.createDataFrame([("a", d, "p", "error", 1, None, None), ("b", d, "p", "ok", 2, "rgb", "median")], schema)
    new = spark.createDataFrame([("a", d, "p", "ok", 3, "rgb", "median"), ("c", d, "p", "error", 4, "rgb", "median")], schema)
    merged = manifest.merge_manifest(old, new)
    assert {r.station_id: r.status for r in merged.collect()} == {"a": "ok", "b": "ok", "c": "error"}
    jobs = spark.createDataFrame([(s, d) for s in "abcde"], "station_id string, week_start date")
    patches = spark.createDataFrame([("d", d)], "station_id string, week_start date")
    assert {r[0] for r in manifest.pending_jobs(jobs, merged, patches, "p", "median").collect()} == {"c", "e"}
    assert tables.load_manifest(spark, "/tmp/no-such-manifest").count() == 0


def test_splits(spark):
    rows = [(f"s{s:02}", date(2023 + w % 2, 3, 1 + w), "ab"[s % 2], float(s + w)) for s in range(20) for w in range(25)]
    table = spark.createDataFrame(rows, "station_id string, week_start date, region string, pm25 double")
    assert dataset.random_split(table, ["station_id", "week_start"]).where("split = 'test'").count() == 100
    folds = dataset.explode_folds(dataset.spatial_folds(table, 5), 5)
    assert {r.leaks for r in dataset.leakage_report(folds).collect()} == {0} and folds.where("split = 'test'").count() == 500
    assert dataset.station_holdout(table).where("split = 'test'").select("station_id").distinct().count() == 4
    assert {r.leaks for r in dataset.leakage_report(dataset.region_split(table), "region").collect()} == {0}
    time = dataset.temporal_split(table, 2024)
    assert time.where("split = 'train' AND year(week_start) >= 2024").count() == 0
    weighed = dataset.weight_high(table, 4.0)
    for draws in (None, 77, 5000):
        counts = {r[:2]: r["n"] for r in dataset.weighted_resample(weighed, ["station_id", "week_start"], draws=draws).groupBy("station_id", "week_start").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert sum(counts.values()) == (draws or 500)
        total = weighed.agg(F.sum("weight")).first()[0]
        for r in weighed.collect():
            assert abs(counts.get((r["station_id"], r["week_start"]), 0) - (draws or 500) * r["weight"] / total) < 1
    odd = spark.createDataFrame([(1, None), (2, float("nan")), (3, -4.0), (4, 1e-3), (5, 0.0)], "k int, weight double")
    assert [r["k"] for r in dataset.weighted_resample(odd, ["k"]).collect()] == [4] * 5
    assert dataset.weighted_resample(odd.where("k <> 4"), ["k"]).count() == 0 and dataset.weighted_resample(odd.where("false"), ["k"]).count() == 0


def test_metrics(spark):
    perfect = spark.createDataFrame([("aabbcc"[i], float(i + 1), float(i + 1)) for i in range(6)], "station_id string, y_true double, y_pred double")
    assert metrics.regression_metrics(perfect).first()["r2"] == 1 and metrics.within_r2(perfect).first()[0] == 1 and metrics.between_r2(perfect).first()[0] == 1
    rng = np.random.default_rng(0)
    rows = [(f"s{s}", float(m + rng.normal(0, 2)), float(m)) for s, m in enumerate(rng.normal(15, 5, 10)) for _ in range(20)]
    means = spark.createDataFrame(rows, "station_id string, y_true double, y_pred double")
    assert metrics.between_r2(means).first()[0] > 0.95 and metrics.within_r2(means).first()[0] <= 0.01
    flat = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 2.0)], "station_id string, y_true double, y_pred double")
    assert metrics.regression_metrics(flat).first()["r2"] == 0 and metrics.classification_metrics(flat).first()["auc"] is None


def test_identity_feature_canary(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{s:02}", date(2023, 1, 1), float(e + rng.normal(0, 1)), [float(s)]) for s, e in enumerate(rng.normal(15, 6, 20)) for _ in range(15)]
    table = spark.createDataFrame(rows, "station_id string, week_start date, pm25 double, features array<double>").withColumn("k", F.monotonically_increasing_id())
    score = lambda t: metrics.regression_metrics(models.fit_predict(t, "rf", 10)).first()["r2"]
    assert score(dataset.random_split(table, ["k"])) > 0.8
    assert score(dataset.station_holdout(table.withColumn("region", F.lit("r")))) < 0.2


def test_patch_statistics(spark):
    frame = spark.createDataFrame([([5, 0, 0, 1], [0, 0, 0, 2], [0, 0, 1, 3], [1, 0, 2, 0], 19724)], "b4 array<int>, b3 array<int>, b2 array<int>, cnt array<int>, day int")
    row = raster.patch_stats(frame).first()
    assert (row["valid_fraction"], row["n_images"]) == (0.5, 2)
    assert raster.patch_stats(frame, "scene").first()["scene_date"] == "2024-01-02"
    assert raster.zero_fraction(frame).first()["zero_frac"] == 0.25
    # Only the second pixel lacks a value in every band; cnt has no part in it.
    filled = raster.fill_invalid(frame).first()
    assert filled["b4"] == [5.0, 2.0, 0.0, 1.0] and filled["b2"] == [0.0, 4 / 3, 1.0, 3.0]
    assert raster.fill_invalid(frame.drop("cnt", "day")).columns == ["b4", "b3", "b2"]


def test_error_classes(spark):
    texts = {
        "Parameter 'image' is required": "no_images", "the generated image has no bands": "no_images", "Deadline Exceeded": "retry",
        "Internal error": "retry", "HTTP 429": "retry", "too many": "error", "timed out": "error", "": "error",
    }
    frame = spark.createDataFrame([(t,) for t in texts] + [(None,)], "m string")
    got = {r["m"]: r["s"] for r in frame.select("m", X.error_status("m").alias("s")).collect()}
    assert got == {**texts, None: "error"}


def test_plan_and_pending_jobs(spark):
    stations = spark.createDataFrame([("a", 10.0, -120.0), ("b", 20.0, -120.0)], "station_id string, lat double, lon double")
    weeks = [("a", date(2024, 1, 1)), ("a", date(2024, 1, 8)), ("a", date(2024, 2, 5))] + [("b", date(2023, 1, 2 + d)) for d in range(20)]
    weekly = spark.createDataFrame(weeks, "station_id string, week_start date")
    plan = lambda *a: sorted((r["station_id"], r["week_start"]) for r in manifest.plan_jobs(weekly, stations, *a).collect())
    # The weeks of other stations do not count when weeks are spread, and both limits hold.
    assert plan(1, 3) == weeks[:3] and plan(1, 1, 1) == weeks[:1] and plan(1, None, 1) == [weeks[0], weeks[2]]
    old = spark.createDataFrame([("a", date(2024, 1, 1), "l1c", "error", 1)], "station_id string, week_start date, product string, status string, ingest_seq long")
    patches = spark.createDataFrame([("a", date(2024, 1, 8), "l1c", "median", "rgb"), ("a", date(2024, 2, 5), "l2a", "median", "rgb")], "station_id string, week_start date, product string, mode string, bands string")
    jobs = weekly.where("station_id = 'a'")
    left = {r["week_start"] for r in manifest.pending_jobs(jobs, old, patches, "l1c", "median").collect()}
    assert left == {date(2024, 1, 1), date(2024, 2, 5)}
    shots = spark.createDataFrame([(1, date(2024, 1, 7)), (2, date(2024, 1, 8)), (3, date(2023, 12, 31))], "scene_id long, scene_date date").selectExpr(
        "*", "-121.0 AS west", "9.0 AS south", "-119.0 AS east", "11.0 AS north"
    )
    boxes = spark.createDataFrame([("a", date(2024, 1, 1), 10.0, -120.0)], "station_id string, week_start date, lat double, lon double")
    assert [r["scene_id"] for r in manifest.scenes_in(shots, boxes, 7).collect()] == [1]


def test_boosting_stops_early_and_models_learn(spark, monkeypatch):
    assert models.best_rounds([3.0, 2.0, 2.5, 2.4, 1.0], 2) == (2, True) and models.best_rounds([3.0, 2.0, 1.0], 2) == (3, False)
    rng = np.random.default_rng(3)
    rows = [(f"s{s:02}", date(2023, 1, 1), 30.0 * (x > 0.5) + 5 + float(rng.normal(0, 1)), [x], "r") for s in range(12) for x in rng.random(12).tolist()]
    table = dataset.station_holdout(spark.createDataFrame(rows, "station_id string, week_start date, pm25 double, features array<double>, region string")).persist()
    calls = []
    real = models.fit_gbt
    monkeypatch.setattr(models, "fit_gbt", lambda train, validation, *a: calls.append((train, validation)) or real(train, validation, *a))
    boosted = models.fit_predict(table, "gbt", 6, stale=2)
    train, validation = ({r[0] for r in t.select("station_id").distinct().collect()} for t in calls[0])
    assert len(train) == 9 and len(validation) == 1 and not train & validation
    r2 = lambda t: metrics.regression_metrics(t).first()["r2"]
    assert boosted.count() == 24 and r2(boosted) > 0.1 and r2(models.fit_log_target(table, 10)) > 0.8
    assert metrics.classification_metrics(models.fit_classifier(table).withColumnRenamed("score", "y_pred"), 20.0).first()["auc"] > 0.9


def test_auc_over_ranges_is_exact(spark):
    import random

    from airlake.operators import metrics as M

    rng = random.Random(2)
    rows = [(g, rng.choice([20.0, 50.0]), round(rng.gauss(30, 9), 1) if g != "c" else 30.0) for g in ("a", "b", None, "c") for _ in range(600)] + [("d", 50.0, 1.0)]
    preds = spark.createDataFrame(rows, "g string, y_true double, y_pred double")

    def auc(some):
        p, n = ([y for _, t, y in some if (t > 35) == hit] for hit in (True, False))
        return sum((a > b) + (a == b) / 2 for a in p for b in n) / (len(p) * len(n)) if p and n else None

    got = {r["g"]: r["auc"] for r in M.classification_metrics(preds, by=["g"]).collect()}
    for g in ("a", "b", None, "c", "d"):
        want = auc([r for r in rows if r[0] == g])
        assert got[g] is None if want is None else abs(got[g] - want) < 1e-12
    assert abs(M.classification_metrics(preds).first()["auc"] - auc(rows)) < 1e-12
