"""Boosted fits that are grown together: the trees of Spark ML, early stopping, blocks, and the grid at its registered sizes."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from airlake.operators import boosting, dataset, models

KEYS = ["station_id", "week_start"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    rows = []
    for s in range(16):
        for w in range(20):
            x = rng.integers(0, 12, 3).astype(float).tolist()
            rows.append((f"s{s:02}", date(2022, 1, 3) + timedelta(7 * w), 5 * (x[0] > 6) + x[1] * x[2] / 9 + float(rng.normal(0, 1)), x, [x[0]], "test" if (s + w) % 4 == 0 else "train"))
    return spark.createDataFrame(rows, "station_id string, week_start date, pm25 double, a array<double>, b array<double>, split string").persist()


def boosted(table, seeds, names=("a", "b"), **options):
    out = {}
    sides = [(F.col("split"), seed) for seed in seeds]
    fits = [(name, k) for name in names for k in range(len(seeds))]
    sizes = boosting.boost(table, KEYS, sides, fits, lambda k, df: out.__setitem__(k, {(r[0], r[1]): np.array(r[2:]) for r in df.collect()}), **options)
    return sizes, [out[k] for k in range(len(fits))]


def test_trees_are_those_of_spark_ml(spark, table):
    # One training station, so nothing is carved out; all rows and features, so nothing is drawn. Rows are tested where they were trained on, as equal splits of them may part other rows differently.
    one = table.withColumns({"station_id": F.lit("s"), "week_start": F.expr("date_add(week_start, 1000 * CAST(substr(station_id, 2) AS INT))")}).where("split = 'train'")
    one = one.unionByName(one.withColumns({"split": F.lit("test"), "station_id": F.lit("t")})).persist()
    for blocks in (1, 3):
        sizes, got = boosted(one, [0], rounds=23, share=1.0, blocks=blocks)
        assert sizes == [23, 23]
        for name, mine in zip("ab", got, strict=True):
            ready = models.with_vector(one.withColumn("features", F.col(name)))
            model = GBTRegressor(featuresCol="features", labelCol="pm25", maxIter=23, stepSize=0.05, maxDepth=5, maxBins=32).fit(ready.where("split = 'train'"))
            want = {(r[0], r[1]): (r[2], r[3]) for r in model.transform(ready.where("split = 'test'")).select(*KEYS, "pm25", "prediction").collect()}
            assert mine.keys() == want.keys() and len(want) == 240
            for key, (y, predicted) in want.items():
                assert mine[key][0] == y and mine[key][1] == pytest.approx(predicted, abs=1e-6)


def test_early_stopping_keeps_the_best_rounds(spark, table):
    sizes, got = boosted(table, [0, 1], rounds=60, stale=5)
    # A fit alone, its rows in several blocks, is the fit among others; its best number of rounds alone gives its predictions.
    alone, mine = boosted(table, [1], ["a"], rounds=60, stale=5, blocks=2)
    same = lambda a, b: a.keys() == b.keys() and all(np.allclose(a[k], b[k], rtol=0, atol=1e-9) for k in a)
    assert alone == [sizes[1]] and same(mine[0], got[1])
    assert min(sizes) >= 1 and len(set(sizes)) > 1 and any(n < 55 for n in sizes)
    n, short = boosted(table, [0], ["b"], rounds=sizes[2], stale=60)
    assert n == [sizes[2]] and same(short[0], got[2])
    y, p = (np.array([v[i] for v in got[0].values()]) for i in (0, 1))
    assert 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.5


def test_stations_are_carved_out_as_elsewhere(spark, table):
    ready = table.withColumn("split", F.expr("CASE WHEN station_id < 's03' THEN 'test' ELSE 'train' END"))
    for seed in (0, 1, 2):
        want = {r[0] for r in dataset.val_carveout(ready, seed=seed).where("split = 'val'").select("station_id").distinct().collect()}
        assert {r[0] for r in boosting._carved(ready, [(F.col("split"), seed)]).collect()} == want and len(want) == 1


def test_boosted_runs_of_the_grid_share_their_jobs(spark, table, tmp_path):
    wide = table.withColumnRenamed("a", "embedding").drop("b", "split").withColumns({"lat": F.lit(1.0), "lon": F.lit(2.0), "week_of_year": F.weekofyear("week_start"), "region": F.lit("r")})
    group = "boosted"
    spark.sparkContext.setJobGroup(group, group)
    grid = lambda **options: models.run_grid(wide, KEYS, ["image", "fused"], {"gbt": 60}, ["random", "spatial"], [0, 1], str(tmp_path), stale=8, k=3, **options)
    out = grid()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert out.select(*models.Run._fields).distinct().count() == 2 * 2 * (1 + 3)
    # 16 fits of 8 rounds and more took five jobs for each round.
    assert jobs < 16 * 9 * 5 / 2
    again = []
    assert grid(fit=lambda ready, run: again.append(run)).count() == out.count() and not again


def test_the_grid_is_registered_at_full_size(spark, monkeypatch):
    from airlake.plans import queries

    seen = []
    monkeypatch.setattr(queries.N, "run_grid", lambda table, *a, **k: seen.append((a, k)) or table)
    queries.QUERIES["n05_run_grid"](spark, "/root/testdata/sf0.001")
    (_, kinds, sizes, splits, seeds), options = seen[0]
    assert kinds == ["image", "spacetime", "fused"] and sizes == {"rf": 300, "gbt": 2000} and seeds == [0, 1, 2]
    assert splits == ["random", "spatial", "temporal"] and options.get("stale", 100) == 100


def test_plans_do_not_multiply_from_split_to_split(spark, table, tmp_path, monkeypatch):
    # With three seeds the plan of all splits read the table 27 times and more, and the driver held all of it.
    wide, real, most = table.withColumnRenamed("a", "embedding").drop("b", "split").withColumn("region", F.lit("r")), models.staged, []

    def counted(df, path):
        most.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return real(df, path)

    monkeypatch.setattr(models, "staged", counted)
    monkeypatch.setattr(models, "boost", lambda *a, **k: None)
    models.run_grid(wide, KEYS, ["image"], {"gbt": 1}, ["random", "spatial"], [0, 1, 2], str(tmp_path), fit=lambda ready, run: ready.selectExpr(*KEYS, "pm25 AS y_true", "pm25 AS y_pred"))
    assert max(most) <= 6
