"""The grid of fits: equal to a serial loop, resumed, and without leaks; models cut to a prefix; inference."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from airlake.operators import dataset, metrics, models

KEYS = ["station_id", "week_start"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    rows = [
        (f"s{s:02}", date(2022, 1, 3) + timedelta(7 * 9 * w), float(e + rng.normal(0, 1)), [float(s), float(rng.random())], "ab"[s % 2], 30.0 + s, -100.0, w + 1)
        for s, e in enumerate(rng.normal(15, 6, 12)) for w in range(12)
    ]
    rows.append(("s00", date(2030, 1, 7), None, [0.0, 0.0], "a", 30.0, -100.0, 1))
    return spark.createDataFrame(rows, "station_id string, week_start date, pm25 double, embedding array<double>, region string, lat double, lon double, week_of_year int").persist()


def test_grid_equals_a_serial_loop(spark, table, tmp_path):
    got = models.run_grid(table, KEYS, ["image", "fused"], {"rf": 5}, ["random", "spatial", "temporal", "region"], [0, 1], str(tmp_path), k=3, year=2023)
    runs = {tuple(r) for r in got.select(*models.Run._fields).distinct().collect()}
    folds = [("random", "0"), ("temporal", "0"), *(("spatial", str(f)) for f in range(3)), ("region", "a"), ("region", "b")]
    assert runs == {(kind, "rf", name, seed, fold) for kind in ("image", "fused") for seed in (0, 1) for name, fold in folds}
    clean = table.where("pm25 IS NOT NULL")
    for kind, seed in (("image", 0), ("fused", 1)):
        ready = dataset.features(clean, kind)
        splits = {
            "random": dataset.random_split(ready, KEYS, seed=seed), "temporal": dataset.temporal_split(ready, 2023),
            "spatial": dataset.explode_folds(dataset.spatial_folds(ready, 3), 3), "region": dataset.region_split(ready),
        }
        for name, one in splits.items():
            mine = got.where((F.col("feature_set") == kind) & (F.col("seed") == seed) & (F.col("split_name") == name))
            rows = lambda df: sorted((str(r["fold"]), r["station_id"], r["week_start"], r["y_true"], round(r["y_pred"], 9)) for r in df.collect())
            assert [r[:4] for r in rows(mine)] == [r[:4] for r in rows(models.fit_predict(one, "rf", 5, seed))]
    # A station's number tells nothing about stations that the fold did not train on.
    r2 = metrics.regression_metrics(got, ["split_name", "feature_set"]).collect()
    scores = {(r["split_name"], r["feature_set"]): r["r2"] for r in r2}
    assert scores["random", "image"] > scores["spatial", "image"] and scores["spatial", "image"] < 0.3
    tested = {seed: {(r[0], r[1]) for r in got.where(f"split_name = 'random' AND feature_set = 'image' AND seed = {seed}").select(*KEYS).collect()} for seed in (0, 1)}
    assert len(tested[0]) == len(tested[1]) == 28 and tested[0] != tested[1]


def test_grid_resumes_and_fits_equal_runs_once(spark, table, tmp_path):
    calls = []

    def fit(ready, run):
        calls.append(run)
        if run.split_name == "spatial" and len(calls) == 3:
            raise RuntimeError("an executor was lost")
        return ready.where("split = 'test'").select(*KEYS, F.col("pm25").alias("y_true"), F.lit(float(run.seed)).alias("y_pred"))

    # Two regions and two folds of stations may be the same split; the region column here makes them so.
    twins = table.withColumn("region", F.expr("CAST(int(substr(station_id, 2)) % 2 AS STRING)"))
    even = dataset.spatial_folds(twins.where("pm25 IS NOT NULL"), 2).select("station_id", F.col("fold").cast("string").alias("f")).distinct()
    twins = twins.join(even, "station_id").withColumn("region", F.col("f")).drop("f")
    grid = lambda: models.run_grid(twins, KEYS, ["image"], {"rf": 1}, ["random", "spatial", "region"], [0, 1], str(tmp_path), parallel=1, k=2, fit=fit)
    with pytest.raises(RuntimeError):
        grid()
    before = {tuple(r) for r in models.finished_runs(spark, f"{tmp_path}/predictions").collect()}
    assert len(calls) > len({c[2:] for c in before if c[2] != "region"}) > 0
    done, calls[:] = set(calls), []
    out = grid()
    assert out.select(*models.Run._fields).distinct().count() == 10
    assert not {c for c in calls} & before and len({c for c in [*done, *calls] if c.split_name != "random"}) == 4
    for seed in (0, 1):
        for fold in ("0", "1"):
            a, b = (sorted(r[0] for r in out.where(f"split_name = '{n}' AND seed = {seed} AND fold = '{fold}'").select("station_id").collect()) for n in ("spatial", "region"))
            assert a == b and a
    calls[:] = []
    assert grid().count() == out.count() and calls == []


def test_cut_model_is_the_shorter_fit(spark):
    rng = np.random.default_rng(5)
    rows = [([float(x), float(y)], float(3 * x + y + rng.normal(0, 0.1))) for x, y in rng.random((80, 2))]
    train = models.with_vector(spark.createDataFrame(rows, "features array<double>, pm25 double")).coalesce(1).persist()
    long, short = (GBTRegressor(featuresCol="features", labelCol="pm25", maxIter=n, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=3).fit(train) for n in (9, 4))
    cut = models.cut_rounds(spark, long, 4)
    assert cut.getNumTrees == 4 and list(cut.treeWeights) == list(short.treeWeights)
    assert [r[0] for r in cut.transform(train).select("prediction").collect()] == [r[0] for r in short.transform(train).select("prediction").collect()]


def test_embedding_of_patches(spark):
    patches = spark.createDataFrame([(k, [float(k), 2.0, -1.0, 5.0]) for k in range(7)], "id int, x array<double>")
    got = {r["id"]: r["embedding"] for r in models.embed(patches, 4, batch=3).collect()}
    for k in range(7):
        x = np.array([k, 2, -1, 5], float)
        assert got[k] == pytest.approx([x.mean(), x.std(), x.min(), x.max()], rel=1e-6)
    doubled = models.embed(patches, 4, lambda: lambda x: (2 * x[:, :1]).astype("float32")).where("id = 3").first()
    assert doubled["embedding"] == [6.0]
