"""Label tables: stations, weeks, overpass days and hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlake.functions import scalars as X
from airlake.operators.clean import filter_complete
from airlake.operators.selection import quantiles


def build_stations(daily: DataFrame) -> DataFrame:
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("date", c))).alias(c)
    return daily.groupBy("station_id").agg(
        F.median("lat").alias("lat"), F.median("lon").alias("lon"), first("site_name"), F.count(F.lit(1)).alias("n_days"), first("region")
    )


def aggregate_weekly(daily: DataFrame, min_pct: float = 75.0, min_days: int = 5) -> DataFrame:
    return (
        filter_complete(daily, min_pct).groupBy("station_id", X.week_start("date").alias("week_start"))
        .agg(F.avg("pm25").alias("pm25"), F.count(F.lit(1)).alias("n_days")).where(F.col("n_days") >= min_days)
    )


def expected_weeks(years: list[int]) -> Column:
    """Number of Mondays in the given calendar years."""
    days = [F.sequence(F.lit(f"{y}-01-01").cast("date"), F.lit(f"{y}-12-31").cast("date")) for y in years]
    return F.size(F.filter(F.flatten(F.array(*days)), lambda d: F.weekday(d) == 0))


def filter_station_coverage(weekly: DataFrame, years: list[int], share: float = 0.7) -> DataFrame:
    """All weeks of the stations that have readings in ``share`` of the weeks of the given years."""
    enough = (
        weekly.where(F.year("week_start").isin(*years)).groupBy("station_id").agg(F.count_distinct("week_start").alias("n"))
        .where(F.col("n") >= share * expected_weeks(years))
    )
    return weekly.join(enough, "station_id", "left_semi")


def restrict_stations(stations: DataFrame, labels: DataFrame) -> DataFrame:
    return stations.join(labels, "station_id", "left_semi")


def daily_labels(daily: DataFrame, stations: DataFrame, min_pct: float = 75.0) -> DataFrame:
    return filter_complete(daily, min_pct).join(stations, "station_id", "left_semi").select("station_id", "date", "pm25")


def label_summary(labels: DataFrame) -> DataFrame:
    """One row: exact median and 95 % quantile of the labels, and the largest one; nulls and NaN do not count."""
    top = labels.agg(F.max(F.when(~F.isnan("pm25"), F.col("pm25"))).alias("max"))
    return quantiles(labels, "pm25", {"median": 0.5, "p95": 0.95}).join(F.broadcast(top))


def overpass_labels(daily: DataFrame, passes: DataFrame) -> DataFrame:
    days = passes.select("station_id", "date").dropDuplicates()
    return (
        daily.join(days, ["station_id", "date"]).groupBy("station_id", X.week_start("date").alias("week_start"))
        .agg(F.avg("pm25").alias("pm25"), F.count_distinct("date").alias("n_days"))
    )


def first_pass_per_day(passes: DataFrame) -> DataFrame:
    return passes.groupBy("station_id", F.to_date("ts").alias("scene_date")).agg(F.min("ts").alias("ts"))


def overpass_hour_labels(hourly: DataFrame, passes: DataFrame, window: int = 1) -> DataFrame:
    """Mean of the hours around each day's first pass; whole hours are compared, and the window ends at midnight."""
    first = first_pass_per_day(passes).select("station_id", "scene_date", F.hour("ts").alias("at"))
    hours = hourly.select("station_id", F.to_date("ts").alias("scene_date"), F.hour("ts").alias("hour"), "pm25")
    near = F.col("hour").between(F.col("at") - window, F.col("at") + window)
    return (
        hours.join(first, ["station_id", "scene_date"]).where(near).groupBy("station_id", "scene_date")
        .agg(F.avg("pm25").alias("pm25"), F.count_distinct("hour").alias("n_hours")).withColumn("week_start", X.week_start("scene_date"))
    )


def scene_labels(scenes: DataFrame, daily: DataFrame) -> DataFrame:
    keyed = scenes.select("station_id", F.to_date("scene_date").alias("date")).dropDuplicates()
    return keyed.join(daily.select("station_id", "date", "pm25"), ["station_id", "date"]).withColumn("week_start", X.week_start("date"))


def scenehour_labels(scenes: DataFrame, hour_labels: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    keyed = scenes.select("station_id", F.to_date("scene_date").alias("scene_date")).dropDuplicates()
    found = keyed.join(hour_labels, ["station_id", "scene_date"])
    return found if keep is None else found.join(keep.where("keep"), ["station_id", "scene_date"], "left_semi")


def label_agreement(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    both = a.select(*keys, F.col("pm25").alias("x")).join(b.select(*keys, F.col("pm25").alias("y")), keys)
    return both.agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("r"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("mean_abs_diff"))


def ingest_counts(daily: DataFrame) -> DataFrame:
    return daily.groupBy(F.year("date").alias("year"), "region").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("station_id").alias("stations"))


def pass_hour_range(passes: DataFrame) -> DataFrame:
    return passes.agg(F.min(F.hour("ts")).alias("first_hour"), F.max(F.hour("ts")).alias("last_hour"))
