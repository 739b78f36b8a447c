"""Model fitting on split tables with Spark ML, and batch inference over patches."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from itertools import product
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from airlake.functions import scalars as X
from airlake.operators import dataset as A
from airlake.operators.boosting import boost
from airlake.operators.dataset import pos_weight, val_carveout
from airlake.operators.manifest import pending_runs
from airlake.operators.metrics import score_runs
from airlake.sources.shared import exists, file_system, shared_folder, staged
from airlake.sources.versioned import partitions, replace_partitions


#: Rows of a training table that one partition holds; small tables are one partition, so that fits side by side do not share tasks.
ROWS = 20_000


def band_statistics():
    """The default embedding: mean, deviation and extremes of the flattened patch."""
    import numpy as np

    def predict(x):
        return np.stack([x.mean(1), x.std(1), x.min(1), x.max(1)], 1).astype("float32")

    return predict


def embed(patches: DataFrame, pixels: int, make_model=band_statistics, batch: int = 256) -> DataFrame:
    """Column embedding of column x (arrays of ``pixels`` numbers); ``make_model`` returns a function of a batch."""
    model = predict_batch_udf(make_model, return_type=ArrayType(FloatType()), batch_size=batch, input_tensor_shapes=[[pixels]])
    return patches.withColumn("embedding", model(F.transform("x", lambda v: v.cast("float"))))


def with_vector(table: DataFrame) -> DataFrame:
    return table.withColumn("features", array_to_vector("features"))


def best_rounds(errors: list[float], stale: int) -> tuple[int, bool]:
    """Rounds of the least error before ``stale`` rounds in a row bring no better one, and whether these have passed."""
    best = 0
    for k, error in enumerate(errors):
        if error < errors[best]:
            best = k
        elif k - best >= stale:
            return best + 1, True
    return best + 1, False


def cut_rounds(spark: SparkSession, model: GBTRegressionModel, rounds: int) -> GBTRegressionModel:
    """The model of its first ``rounds`` trees: boosting never changes earlier ones, so this is what fewer rounds would have fitted."""
    java = model._java_obj
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = gateway.new_array(jvm.double, rounds)
    for k in range(rounds):
        trees[k], weights[k] = java.trees()[k], java.treeWeights()[k]
    cut = GBTRegressionModel(jvm.org.apache.spark.ml.regression.GBTRegressionModel(java.uid(), trees, weights, java.numFeatures()))
    return cut.setFeaturesCol(model.getFeaturesCol()).setPredictionCol(model.getPredictionCol())


def fit_gbt(train: DataFrame, validation: DataFrame | None = None, rounds: int = 2000, seed: int = 0, stale: int = 100):
    """Boosted trees; with validation rows, the prefix of rounds with the least squared error before ``stale`` rounds without a better one.

    The rounds fitted are doubled until that many are stale, so the rest of ``rounds`` is only fitted where it counts; the prefix is cut from the model.
    """
    settings = {"featuresCol": "features", "labelCol": "pm25", "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": seed}
    if validation is None:
        return GBTRegressor(maxIter=rounds, **settings).fit(train)
    n = min(rounds, stale + stale // 2)
    while True:
        model = GBTRegressor(maxIter=n, **settings).fit(train)
        best, stopped = best_rounds(model.evaluateEachIteration(validation, "squared"), stale)
        if stopped or n == rounds:
            return model if best == n else cut_rounds(train.sparkSession, model, best)
        n = min(rounds, 2 * n)


def fit_rf(train: DataFrame, trees: int = 300, seed: int = 0):
    return RandomForestRegressor(featuresCol="features", labelCol="pm25", numTrees=trees, seed=seed).fit(train)


def fit_predict(table: DataFrame, model: str = "rf", size: int = 100, seed: int = 0, fold=None, stale: int = 100) -> DataFrame:
    """Fit on the rows of split train, predict those of test; ``size`` counts trees or rounds.

    Boosting stops early by the rows of split val; without any, a tenth of the training stations is carved out for it.

    With a column fold, each fold is fitted and predicted on its own rows: on tables that hold a row once for every
    fold, other folds train on the rows that this one predicts. ``fold`` names one of them, else all are run.
    """
    # Boosting is many short jobs over one tree at a time; a forest grows its trees in few jobs, all at once.
    table = _ready(table, ROWS if model != "rf" else ROWS // 20)
    if "fold" in table.columns and fold is None:
        out = None
        for key in _keys(table, "fold"):
            part = _fit_predict(table.where(F.col("fold") == F.lit(key)), model, size, seed, stale)
            out = part if out is None else out.unionByName(part)
        if out is not None:
            return out
    return _fit_predict(table if fold is None else table.where(F.col("fold") == F.lit(fold)), model, size, seed, stale)


def _ready(table: DataFrame, rows: int = ROWS) -> DataFrame:
    """Labelled rows, written once, a partition for about ``rows``: fitting and predicting pass over them many times, and must not compute them from their sources each time."""
    written = staged(table.where("pm25 IS NOT NULL").drop("embedding"), shared_folder(table.sparkSession, "fit"))
    return written.repartition(_parts(table.sparkSession, written.count(), rows))


def _parts(spark: SparkSession, count: int, rows: int = ROWS) -> int:
    return max(1, min(spark.sparkContext.defaultParallelism, -(-count // rows)))


def _fit_predict(table: DataFrame, model: str, size: int, seed: int, stale: int) -> DataFrame:
    """``fit_predict`` of one fold's labelled rows, which are cheap to read."""
    ready = with_vector(table)
    if model == "rf":
        fitted = fit_rf(ready.where("split = 'train'"), size, seed)
    else:
        # One station cannot be on both sides.
        if ready.where("split = 'val'").isEmpty() and ready.where("split = 'train'").select("station_id").distinct().limit(2).count() == 2:
            ready = val_carveout(ready, seed=seed)
        ready = ready.coalesce(_parts(table.sparkSession, table.count())).persist()  # read by every round
        validation = ready.where("split = 'val'")
        fitted = fit_gbt(ready.where("split = 'train'"), None if validation.isEmpty() else validation, size, seed, stale)
        ready.unpersist()
    keys = [c for c in ("station_id", "week_start", "split_name", "fold") if c in table.columns]
    return fitted.transform(ready.where("split = 'test'")).select(*keys, F.col("pm25").alias("y_true"), F.col("prediction").alias("y_pred"))


def _keys(table: DataFrame, column: str) -> list:
    """The column's values that have test rows, in order; few, as each takes a fit."""
    rows = table.where((F.col("split") == "test") & F.col(column).isNotNull()).select(column).distinct().collect()
    return sorted(r[0] for r in rows)


class Run(NamedTuple):
    """Keys of one fit of a grid; fold is text, as regions are folds, too."""

    feature_set: str
    model: str
    split_name: str
    seed: int
    fold: str


RUN = "feature_set string, model string, split_name string, seed int, fold string"
PREDICTED = f"station_id string, week_start date, y_true double, y_pred double, {RUN}"


def assign_splits(table: DataFrame, keys: list[str], names: list[str], seeds: list[int], k: int = 5, year: int = 2024, keep: Callable = lambda table: table) -> DataFrame:
    """The table with its splits as columns, a row once: random_<seed> and temporal say train or test, spatial and region the fold that tests the row.

    Splits that read the table several times go through ``keep``; where it writes them, plans do not multiply from split to split.
    """
    for name in names:
        if name == "random":
            for seed in seeds:
                table = keep(A.random_split(table, keys, seed=seed).drop("fold").withColumnRenamed("split", f"random_{seed}"))
        elif name == "spatial":
            table = keep(A.spatial_folds(table, k).withColumnRenamed("fold", "spatial"))
        elif name == "temporal":
            table = A.temporal_split(table, year).drop("fold").withColumnRenamed("split", "temporal")
        elif name == "region":
            table = table.withColumn("_region", F.col("region"))
        else:
            raise ValueError(f"unknown split: {name}")
    return table


def _side(split_name: str, seed: int, fold: str) -> Column:
    """train, test or null for a row of ``assign_splits``."""
    if split_name in ("random", "temporal"):
        return F.col(f"random_{seed}" if split_name == "random" else "temporal")
    column = F.col("_region" if split_name == "region" else "spatial")
    return F.when(column.cast("string") == fold, "test").otherwise("train")


def _memberships(table: DataFrame, keys: list[str], names: list[str], seeds: list[int]) -> dict[tuple, tuple]:
    """(split, seed, fold) -> a fingerprint of which rows it trains on and tests; sides without rows leave it out. One pass over the table."""
    places = []
    for name in names:
        if name in ("random", "temporal"):
            places += [(name, seed, "0") for seed in seeds]
        else:
            column = "_region" if name == "region" else "spatial"
            folds = [str(r[0]) for r in table.select(column).where(f"{column} IS NOT NULL").distinct().collect()]  # a fit for each
            places += [(name, seed, fold) for fold in sorted(folds) for seed in seeds]
    row = F.xxhash64(*keys).cast("decimal(38,0)")
    sums = []
    for k, place in enumerate(places):
        sums += [f(F.when(_side(*place) == side, row)).alias(f"{f.__name__}_{side}_{k}") for side in ("train", "test") for f in (F.sum, F.count)]
    found = table.agg(*sums).first() if sums else {}
    prints = {place: tuple(found[f"{f}_{side}_{k}"] for side in ("train", "test") for f in ("count", "sum")) for k, place in enumerate(places)}
    return {place: p for place, p in prints.items() if p[0] and p[2]}


def _leaf(root: str, run: Run) -> str:
    return "/".join([root, *(f"{name}={value}" for name, value in zip(Run._fields, run, strict=True))])


def finished_runs(spark, root: str) -> DataFrame:
    """Keys of the runs whose predictions below ``root`` are complete; a write that broke off has left no mark."""
    found = []
    if exists(spark, root):
        fs, place = file_system(spark, root + "/" + "/".join(f"{name}=*" for name in Run._fields) + "/_SUCCESS")
        for status in fs.globStatus(place):
            parts = dict(p.split("=", 1) for p in status.getPath().toString().split("/")[-6:-1])
            found.append(Run(parts["feature_set"], parts["model"], parts["split_name"], int(parts["seed"]), parts["fold"]))
    return spark.createDataFrame(found, RUN)


def run_grid(
    table: DataFrame, keys: list[str], feature_sets: list[str], models: dict[str, int], splits: list[str], seeds: list[int],
    root: str | None = None, parallel: int = 8, stale: int = 100, k: int = 5, year: int = 2024, fit: Callable | None = None,
) -> DataFrame:
    """Predictions of every feature set x model x split x seed x fold that has training and test rows, with the run's keys as columns.

    ``table`` has the columns of a model table; ``models`` gives trees or rounds for rf and gbt. Features and splits are written once below ``root``, a row
    once, and every fit reads the columns it needs. Runs that are complete there already are left out, so a call after a failure goes on with
    the rest; fits of the same rows, features, model and seed are done once and written under each key. ``parallel`` fits run at a time, each from a thread
    and in a scheduler pool of its own. Predictions are read back from their partitions.
    """
    spark = table.sparkSession
    root = root or shared_folder(spark, "grid")
    fitted = fit is None
    fit = fit or (lambda ready, run: _fit_predict(ready, run.model, models[run.model], run.seed, stale))
    copies = [f"{root}/labelled"]

    def rewritten(one: DataFrame) -> DataFrame:
        copies.append(f"{root}/labelled-{len(copies)}")
        one = staged(one, copies[-1])
        fs, place = file_system(spark, copies[-2])
        fs.delete(place, True)
        return one

    # Each split reads the table more than once.
    known = staged(table.where("pm25 IS NOT NULL"), copies[0])
    wide = assign_splits(known, keys, splits, seeds, k, year, rewritten)
    for kind in feature_sets:
        wide = A.features(wide, kind).withColumnRenamed("features", f"features_{kind}")
    wide = staged(wide.drop("embedding"), f"{root}/table")
    prints = _memberships(wide, keys, splits, seeds)
    grid = [Run(kind, model, name, seed, fold) for kind, model, (name, seed, fold) in product(feature_sets, models, prints)]
    asked = spark.createDataFrame(grid, RUN)
    todo = [Run(*r) for r in pending_runs(asked, finished_runs(spark, f"{root}/predictions")).collect()]  # keys of the grid
    equal: dict[tuple, list[Run]] = {}
    for run in todo:
        equal.setdefault((run.feature_set, run.model, run.seed, prints[run[2:]]), []).append(run)
    most = max((p[0] + p[2] for p in prints.values()), default=0)
    parts = _parts(spark, most)

    def keep(runs: list[Run], predicted: DataFrame) -> None:
        predicted = predicted.select("station_id", "week_start", "y_true", "y_pred").coalesce(parts)
        predicted.write.mode("overwrite").parquet(_leaf(f"{root}/predictions", runs[0]))
        for other in runs[1:]:
            spark.read.parquet(_leaf(f"{root}/predictions", runs[0])).write.mode("overwrite").parquet(_leaf(f"{root}/predictions", other))

    def one(runs: list[Run]) -> None:
        first = runs[0]
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", "-".join(map(str, first)))
        ready = wide.select(*keys, "pm25", F.col(f"features_{first.feature_set}").alias("features"), _side(*first[2:]).alias("split"))
        keep(runs, fit(ready.where("split IS NOT NULL").coalesce(parts), first))

    def together(several: list[list[Run]]) -> None:
        places = list(dict.fromkeys(runs[0][2:] for runs in several))
        sides = [(_side(*place), place[1]) for place in places]
        fits = [(f"features_{runs[0].feature_set}", places.index(runs[0][2:])) for runs in several]
        blocks = -(-most // ROWS)
        boost(wide, keys, sides, fits, lambda k, predicted: keep(several[k], predicted), models["gbt"], stale, blocks=blocks, root=f"{root}/boosting", parallel=parallel)

    groups = list(equal.values())
    boosted = [runs for runs in groups if fitted and runs[0].model == "gbt"]
    with ThreadPoolExecutor(parallel) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(together), boosted)] if boosted else []
        started += [pool.submit(inheritable_thread_target(spark)(one), runs) for runs in groups if runs not in boosted]
        for done in started:
            done.result()
    if not grid:
        return spark.createDataFrame([], PREDICTED)
    predictions = spark.read.schema(PREDICTED).parquet(f"{root}/predictions")
    return predictions.join(F.broadcast(asked), list(Run._fields), "left_semi").select(*[c.split()[0] for c in PREDICTED.split(", ")])


def resume_metrics(grid: DataFrame, root: str, fit: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """Scores of every run of ``grid`` (its columns are the run's keys), fitted now or before.

    Predictions lie below ``root`` in a folder for each run. Runs that have one are not fitted again; ``fit`` gets the others and returns their predictions, of ``schema``, which are written there. Then all
    are scored in one pass over the partitions of the grid's runs.
    """
    spark, keys = grid.sparkSession, grid.columns
    found = spark.createDataFrame(partitions(spark, root, keys), ", ".join(f"{k} string" for k in keys))
    done = found.select(*[F.col(k).cast(grid.schema[k].dataType) for k in keys])
    todo = pending_runs(grid, done)
    if not todo.isEmpty():
        replace_partitions(fit(todo), root, keys)
    predictions = spark.read.schema(schema).parquet(root)
    return score_runs(predictions.join(grid, keys, "left_semi"), keys)


def fit_classifier(table: DataFrame, threshold: float = 20.0) -> DataFrame:
    """Probability of exceeding the threshold for test rows, positives weighted by the class ratio."""
    table = _ready(table)
    ready = with_vector(table).withColumn("label", X.exceeds("pm25", threshold).cast("double"))
    train = ready.where("split = 'train'").join(F.broadcast(pos_weight(table.where("split = 'train'"), threshold).select("pos_weight")))
    train = train.withColumn("_w", F.when(F.col("label") == 1, F.greatest("pos_weight", F.lit(1e-6))).otherwise(1.0))
    fitted = LogisticRegression(featuresCol="features", labelCol="label", weightCol="_w", maxIter=30).fit(train)
    scored = fitted.transform(ready.where("split = 'test'"))
    return scored.select("station_id", "week_start", F.col("pm25").alias("y_true"), vector_to_array("probability")[1].alias("score"))


def fit_log_target(table: DataFrame, trees: int = 300, seed: int = 0) -> DataFrame:
    logged = table.withColumn("pm25", X.log_target("pm25"))
    return fit_predict(logged, "rf", trees, seed).withColumns({"y_true": F.expm1("y_true"), "y_pred": F.expm1("y_pred")})
