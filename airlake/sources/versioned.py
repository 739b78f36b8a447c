"""Tables that are replaced as a whole: a new snapshot, then one pointer that readers follow."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from py4j.protocol import Py4JJavaError

from airlake.sources.shared import exists, file_system


class Conflict(RuntimeError):
    """Another writer replaced the table first; read it again and repeat the change."""


class Versioned:
    """A table below ``root``: snapshots in data/, and in _commits/ a numbered pointer to each of the last ``keep`` ones.

    A write makes a folder that nobody reads, and ends with the rename of a pointer to the next number, which fails where that number is taken. So readers see the old
    table or the new one, a write that breaks off changes nothing, and of two writers that started from the same version one gets ``Conflict``.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 3):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), max(1, keep)
        self.fs, self.commits = file_system(spark, f"{self.root}/_commits")

    def versions(self) -> list[int]:
        """Numbers of the versions that can be read, rising."""
        if not self.fs.exists(self.commits):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.commits)]
        return sorted(int(n) for n in names if n.isdigit())

    def _snapshot(self, version: int) -> dict:
        stream = self.fs.open(file_system(self.spark, f"{self.root}/_commits/{version:010}")[1])
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The last version, or an earlier one."""
        known = self.versions()
        if not known or version is not None and version not in known:
            raise FileNotFoundError(f"{self.root} has no version" + ("" if version is None else f" {version}"))
        pointer = self._snapshot(known[-1] if version is None else version)
        return self.spark.read.schema(pointer["schema"]).parquet(f"{self.root}/{pointer['data']}")

    def write(self, df: DataFrame, partition_by: list[str] | None = None, after: int | None = None) -> int:
        """Replace the table, which ``df`` may read, and return the new version. ``after`` is the version that ``df`` was made from (by default the last one)."""
        before = after if after is not None else max(self.versions(), default=0)
        data = f"data/{uuid.uuid4().hex}"
        try:
            df.write.partitionBy(*(partition_by or [])).parquet(f"{self.root}/{data}")
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
            self._commit(before + 1, {"data": data, "schema": schema})
        except Exception:
            self.fs.delete(file_system(self.spark, f"{self.root}/{data}")[1], True)
            raise
        self._prune()
        return before + 1

    def update(self, change: Callable[[DataFrame | None], DataFrame], partition_by: list[str] | None = None) -> int:
        """Replace the table by ``change`` of it (of None, where there is none yet)."""
        before = max(self.versions(), default=0)
        return self.write(change(self.read(before) if before else None), partition_by, before)

    def _commit(self, version: int, pointer: dict) -> None:
        jvm = self.spark.sparkContext._jvm
        draft = file_system(self.spark, f"{self.root}/_commits/.{uuid.uuid4().hex}")[1]
        stream = self.fs.create(draft, False)
        stream.write(bytearray(json.dumps(pointer).encode()))
        stream.close()
        place = file_system(self.spark, f"{self.root}/_commits/{version:010}")[1]
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, place, options)
        except Py4JJavaError as error:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
                raise Conflict(f"version {version} of {self.root} was written by another") from None
            raise

    def _prune(self) -> None:
        """Drop versions beyond the last ``keep``: the pointer first, so that it never leads to nothing."""
        for version in self.versions()[: -self.keep]:
            data = self._snapshot(version)["data"]
            self.fs.delete(file_system(self.spark, f"{self.root}/_commits/{version:010}")[1], False)
            self.fs.delete(file_system(self.spark, f"{self.root}/{data}")[1], True)


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Write ``df`` by ``keys`` and replace the partitions that it has rows of; others stay. Spark moves them when all tasks have ended."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def partitions(spark: SparkSession, path: str, keys: list[str]) -> list[tuple]:
    """Values of ``keys``, as text or None, of the partitions below ``path``: a listing of folders, without a look into files."""
    if not exists(spark, path):
        return []
    fs, pattern = file_system(spark, path.rstrip("/") + "".join(f"/{k}=*" for k in keys))
    found = []
    for status in fs.globStatus(pattern):
        values = [unquote(p.split("=", 1)[1]) for p in status.getPath().toString().split("/")[-len(keys) :]]
        found.append(tuple(None if v == "__HIVE_DEFAULT_PARTITION__" else v for v in values))
    return found
