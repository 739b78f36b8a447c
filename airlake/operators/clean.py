"""Cleaning of daily and hourly readings, manifest and scene filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlake.functions import scalars as X


def filter_states(raw: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows of the wanted states, tagged with their region; codes are compared as they are, before padding."""
    return raw.drop("region").join(regions.select("region", "state_code"), "state_code")


def filter_duration(df: DataFrame) -> DataFrame:
    return df.where(F.col("sample_duration").contains("24"))


def drop_excluded(df: DataFrame) -> DataFrame:
    """Only explicit exclusions go; a null event type stays."""
    return df.where(~F.col("event_type").eqNullSafe("Excluded"))


def with_station(df: DataFrame) -> DataFrame:
    return df.withColumn("station_id", X.station_id("state_code", "county_code", "site_num"))


def _lowest_poc(df: DataFrame, keys: list[str], ties: list[str]) -> DataFrame:
    order = [F.col(c).asc_nulls_last() for c in ["poc", *[t for t in ties if t in df.columns]]]
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def dedupe_lowest_poc(df: DataFrame, ties: tuple[str, ...] = ("seq", "line")) -> DataFrame:
    """One reading per station and date, the one of the lowest POC; nulls last."""
    return _lowest_poc(df, ["station_id", "date"], list(ties))


def dedupe_hourly(df: DataFrame, ties: tuple[str, ...] = ("seq",)) -> DataFrame:
    return _lowest_poc(df, ["station_id", "ts"], list(ties))


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.dropna("any")


def filter_complete(df: DataFrame, min_pct: float = 75.0) -> DataFrame:
    return df.where(F.col("obs_percent") >= min_pct)


def clean_daily(raw: DataFrame, regions: DataFrame) -> DataFrame:
    """Daily readings: wanted states, 24-hour samples, no exclusions, lowest POC, no negatives."""
    kept = with_station(drop_excluded(filter_duration(filter_states(raw, regions)))).withColumn("date", F.to_date("date_local"))
    return dedupe_lowest_poc(kept).select(
        "station_id", "date", X.clip_lower(X.nan_to_null("arithmetic_mean")).alias("pm25"), "obs_percent", "lat", "lon", "site_name", "region"
    )


def clean_hourly(raw: DataFrame, regions: DataFrame) -> DataFrame:
    """Hourly readings; the lowest POC is taken before nulls go, so a null there hides a higher one."""
    kept = with_station(filter_states(raw, regions)).withColumn("ts", X.utc_time("date_gmt", "time_gmt"))
    return drop_incomplete(dedupe_hourly(kept).select("station_id", "ts", X.clip_lower(X.nan_to_null("sample_measurement")).alias("pm25")))


def select_scenes(manifest: DataFrame, product: str, mode: str, bands: str = "rgb") -> DataFrame:
    return manifest.where(
        (F.col("product") == product) & (F.col("mode") == mode) & (F.coalesce("bands", F.lit("rgb")) == bands)
        & (F.col("status") == "ok") & (F.coalesce("scene_date", F.lit("")) != "")
    )


def keep_reason(min_valid: float = 0.5, low: float = 20.0, max_zero: float = 0.25, floor: float = 2.5) -> Column:
    """The first rule that a scene violates, or an empty text."""
    return (
        F.when((F.coalesce("valid_fraction", F.lit(1.0)) < min_valid) & (F.col("pm25") <= low), "cloud_low_label")
        .when(F.col("n_hours") == 1, "single_hour_label").when(F.col("zero_frac") > max_zero, "tile_edge_zeros")
        .when(F.col("pm25") < floor, "pm_below_2.5").otherwise("")
    )


def scene_keep(scenes: DataFrame) -> DataFrame:
    return scenes.withColumn("reason", keep_reason()).withColumn("keep", F.col("reason") == "")


def regime(df: DataFrame, min_pm: float | None = None, max_pm: float | None = None) -> DataFrame:
    """Bounds on the truth of training rows only; all others stay."""
    inside = F.lit(True)
    if min_pm is not None:
        inside &= F.col("pm25") > min_pm
    if max_pm is not None:
        inside &= F.col("pm25") <= max_pm
    return df.where((F.col("split") != "train") | inside)


def filter_years(df: DataFrame, years: list[int], date: str = "week_start") -> DataFrame:
    return df.where(F.year(date).isin(*years))
