"""Scores of predictions, for any grouping, and composition of models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlake.functions import scalars as X
from airlake.operators.dataset import bucket
from airlake.operators.selection import quantiles

#: Ranges over which the scores of one group are dealt.
RANGES = 256


def anomaly(df: DataFrame, column: str, by: str) -> DataFrame:
    return df.withColumn("anomaly", F.col(column) - F.avg(column).over(Window.partitionBy(by)))


def _r2(sse: Column, sst: Column) -> Column:
    """Null below two rows is left to the caller; a constant truth scores 1 if exact, else 0."""
    return F.when(sst > 0, 1 - sse / sst).otherwise(F.when(sse == 0, 1.0).otherwise(0.0))


def regression_metrics(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    err = F.col("y_true") - F.col("y_pred")
    n = F.count(F.lit(1))
    return preds.groupBy(*(by or [])).agg(
        F.when(n >= 2, _r2(F.sum(err * err), F.var_pop("y_true") * n)).alias("r2"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"), n.alias("n")
    )


def between_r2(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """R2 of the station means, null below three stations."""
    by = by or []
    means = preds.groupBy(*by, "station_id").agg(F.avg("y_true").alias("t"), F.avg("y_pred").alias("p"))
    n, err = F.count(F.lit(1)), F.col("t") - F.col("p")
    return means.groupBy(*by).agg(F.when(n >= 3, _r2(F.sum(err * err), F.var_pop("t") * n)).alias("between_station_r2"), n.alias("stations"))


def within_r2(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """R2 of deviations from station means, null if the truth never deviates."""
    by = by or []
    n = F.count(F.lit(1))
    parts = preds.groupBy(*by, "station_id").agg((F.var_pop(F.col("y_true") - F.col("y_pred")) * n).alias("e"), (F.var_pop("y_true") * n).alias("t"))
    return parts.groupBy(*by).agg(F.when(F.sum("t") > 0, 1 - F.sum("e") / F.sum("t")).alias("within_station_r2"))


def score_runs(preds: DataFrame, by: list[str]) -> DataFrame:
    """One row for each run: R2, RMSE, MAE, n, and R2 between and within stations."""
    out = regression_metrics(preds, by).alias("m")
    for k, other in enumerate((between_r2(preds, by).drop("stations"), within_r2(preds, by))):
        same = reduce(lambda a, b: a & b, [F.col(f"m.{c}").eqNullSafe(F.col(f"o{k}.{c}")) for c in by])
        out = out.join(other.alias(f"o{k}"), same)
    return out.select("m.*", "between_station_r2", "within_station_r2")


def classification_metrics(preds: DataFrame, threshold: float = 35.0, by: list[str] | None = None, score: str = "y_pred") -> DataFrame:
    """prevalence, accuracy, f1 (0 where undefined) and auc (null with one class) of exceeding the threshold.

    The AUC is a rank sum over counts for each distinct score, ties counting half. The scores of a group are dealt over
    ranges between approximate quantiles; the ranges' totals add up what lies below, so the sum is exact and no group is one task.
    """
    by = by or []
    pos = X.exceeds("y_true", threshold)
    hit = X.exceeds("y_pred", threshold)
    base = preds.groupBy(*by).agg(
        F.avg(pos).alias("prevalence"), F.avg((pos == hit).cast("int")).alias("accuracy"),
        F.sum(pos * hit).alias("_tp"), F.sum(pos + hit).alias("_d"),
    ).withColumn("f1", F.when(F.col("_d") > 0, 2 * F.col("_tp") / F.col("_d")).otherwise(0.0)).drop("_tp", "_d")
    counts = preds.groupBy(*by, F.col(score).alias("_s")).agg(F.sum(pos).alias("_p"), F.sum(1 - pos).alias("_n"))
    bounds = counts.groupBy(*by).agg(F.percentile_approx("_s", [k / RANGES for k in range(1, RANGES)], 10 * RANGES).alias("_q"))
    same = reduce(lambda a, b: a & b, [F.col(f"m.{c}").eqNullSafe(F.col(f"a.{c}")) for c in by], F.lit(True))
    part = F.coalesce(F.size(F.filter("_q", lambda q: q < F.col("_s"))), F.lit(0)).alias("_r")
    placed = counts.alias("m").join(bounds.alias("a") if by else F.broadcast(bounds.alias("a")), same).select("m.*", part)
    totals = placed.groupBy(*by, "_r").agg(F.sum("_n").alias("_t"))
    before = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    lower = totals.select(*by, "_r", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_l"))
    within = Window.partitionBy(*by, "_r").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        placed.withColumn("_w", F.coalesce(F.sum("_n").over(within), F.lit(0))).alias("m")
        .join(lower.alias("a"), same & (F.col("m._r") == F.col("a._r"))).select("m.*", (F.col("_w") + F.col("_l")).alias("_b"))
    )
    auc = ranked.groupBy(*by).agg((F.sum(F.col("_p") * (F.col("_b") + F.col("_n") / 2)) / F.nullif(F.sum("_p") * F.sum("_n"), F.lit(0))).alias("auc"))
    if not by:
        return base.join(F.broadcast(auc))
    return base.alias("m").join(auc.alias("a"), same).select("m.*", "a.auc")


def summarize_folds(metrics: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    return metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("n_folds"), *[F.avg(v).alias(v) for v in values])


def fold_spread(metrics: DataFrame, by: list[str], value: str) -> DataFrame:
    return metrics.groupBy(*by).agg(F.median(value).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"))


def summarize_seeds(folds: DataFrame, by: list[str], values: list[str], digits: int = 3) -> DataFrame:
    return folds.groupBy(*by).agg(*[F.round(F.avg(v), digits).alias(v) for v in values])


def common_exam(preds: DataFrame, training: DataFrame, keys: list[str], floor: float | None = None) -> DataFrame:
    """Rows that every model predicted, at stations that no model (model, station_id) was trained on."""
    kept = preds if floor is None else preds.where(F.col("y_true") >= floor)
    kept = kept.join(training.select("station_id").distinct(), "station_id", "left_anti")
    models = preds.agg(F.count_distinct("model").alias("_m"))
    full = kept.groupBy(*keys).agg(F.count_distinct("model").alias("_k")).join(F.broadcast(models)).where("_k = _m").select(*keys)
    return kept.join(full, keys, "left_semi").select(*preds.columns)


def bucket_errors(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    err = F.col("y_pred") - F.col("y_true")
    return preds.withColumn("bucket", bucket("y_true")).groupBy(*(by or []), "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"), F.avg(err).alias("bias"), F.avg("y_true").alias("mean_true"), F.avg("y_pred").alias("mean_pred")
    )


def hit_rates(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Exact median of the absolute error, shares of errors up to 3 and 5, and the mean error."""
    by = by or []
    err = F.abs(F.col("y_pred") - F.col("y_true"))
    rates = preds.groupBy(*by).agg(
        F.avg((err <= 3).cast("int")).alias("within_3"), F.avg((err <= 5).cast("int")).alias("within_5"), F.avg(F.col("y_pred") - F.col("y_true")).alias("bias")
    )
    mid = quantiles(preds, err, {"median_abs_error": 0.5}, by)
    if not by:
        return mid.join(F.broadcast(rates))
    same = reduce(lambda a, b: a & b, [F.col(f"m.{c}").eqNullSafe(F.col(f"a.{c}")) for c in by])
    return rates.alias("a").join(mid.alias("m"), same).select(*[f"a.{c}" for c in by], "median_abs_error", "within_3", "within_5", "bias")


def calibration(preds: DataFrame, by: list[str]) -> DataFrame:
    return preds.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("y_true").alias("mean_true"), F.avg("y_pred").alias("mean_pred"))


def consolidate(runs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs)


def column_winners(table: DataFrame, arm: str, best: dict[str, str]) -> DataFrame:
    """For each metric the arm with the best value; ``best`` maps metrics to max or min."""
    long = table.unpivot([arm], list(best), "metric", "value").where("value IS NOT NULL")
    sign = F.when(F.col("metric").isin(*[m for m, d in best.items() if d == "min"]), -F.col("value")).otherwise(F.col("value"))
    order = Window.partitionBy("metric").orderBy(sign.desc(), arm)
    return long.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").select("metric", arm, "value")


def route_hard(wide: DataFrame, threshold: float = 20.0) -> DataFrame:
    return wide.withColumn("y_pred", F.when(F.col("router") >= threshold, F.col("smoke")).otherwise(F.col("clean")))


def route_sweep(wide: DataFrame, thresholds: tuple[float, ...] = (10.0, 15.0, 20.0, 25.0)) -> DataFrame:
    copies = wide.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    routed = copies.withColumn("y_pred", F.when(F.col("router") >= F.col("threshold"), F.col("smoke")).otherwise(F.col("clean")))
    share = copies.groupBy("threshold").agg(F.avg((F.col("router") >= F.col("threshold")).cast("int")).alias("routed_share"))
    scores = regression_metrics(routed, ["threshold"]).join(classification_metrics(routed, by=["threshold"]), "threshold")
    return scores.join(share, "threshold")


def blend_soft(wide: DataFrame, centre: float = 20.0, scale: float = 3.0) -> DataFrame:
    p = X.logistic("router", centre, scale)
    return wide.withColumn("y_pred", (1 - p) * F.col("clean") + p * F.col("smoke"))


def ensemble_mean(preds: DataFrame, keys: list[str]) -> DataFrame:
    return preds.groupBy(*keys).agg(F.avg("y_pred").alias("y_pred"), F.count(F.lit(1)).alias("n_models"))


def align_models(preds: DataFrame, keys: list[str], models: list[str]) -> DataFrame:
    return preds.groupBy(*keys).pivot("model", models).agg(F.first("y_pred"))
