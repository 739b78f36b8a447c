"""Readers and writers: tables, manifests and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from airlake.operators.manifest import merge_manifest, with_defaults
from airlake.sources.shared import exists
from airlake.sources.versioned import Versioned, replace_partitions

MANIFEST = (
    "station_id string, week_start date, product string, status string, valid_fraction double, n_images int, error string, mode string, "
    "scene_date string, bands string, ingest_seq long"
)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def write_table(df: DataFrame, root: str, name: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(f"{root}/{name}")


def regions_df(spark: SparkSession, regions: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(regions, "region string, state_code string")


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest with defaults for columns that older ones lack or hold nulls in; an empty one where there is none. Columns of ``MANIFEST`` that it lacks are null."""
    if not exists(spark, path):
        return with_defaults(spark.createDataFrame([], MANIFEST))
    found = spark.read.parquet(path)
    return with_defaults(spark.createDataFrame([], MANIFEST).unionByName(found, allowMissingColumns=True))


def manifest_table(spark: SparkSession, root: str, keep: int = 3) -> Versioned:
    return Versioned(spark, root, keep)


def record_jobs(table: Versioned, new: DataFrame) -> int:
    """Merge the rows of finished jobs into the manifest, the last one of each key staying, and return its new version."""
    return table.update(lambda old: merge_manifest(new.limit(0) if old is None else old, new))


def write_run(predictions: DataFrame, results: DataFrame, root: str, run_keys: list[str]) -> int:
    """Predictions by run, of which those in ``predictions`` are replaced and others stay, and the results as a new version, as Parquet and as JSON lines beside it."""
    spark = predictions.sparkSession
    replace_partitions(predictions, f"{root}/predictions", run_keys)
    table = Versioned(spark, f"{root}/results")
    version = table.write(results)
    # one small row for each run
    table.read(version).coalesce(1).write.mode("overwrite").json(f"{root}/results_json/{version:010}")
    return version


def read_run(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(predictions of all runs, the last results)."""
    return spark.read.parquet(f"{root}/predictions"), Versioned(spark, f"{root}/results").read()
