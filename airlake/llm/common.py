"""Shared pieces of the text operators: scratch tables, link components, candidate pairs."""

from __future__ import annotations

import re
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Scratch:
    """Intermediate tables in the folder that the cluster shares (``spark.checkpoint.dir``).

    A written table cuts the lineage, so a lost executor costs one stage and not the whole job. Where the session
    names no folder, a local master (tests, a laptop) gets a temporary one; on a cluster that is an error, as its
    machines share no temporary folder. ``close`` deletes what is left once nothing reads the results any more.
    """

    def __init__(self, spark: SparkSession):
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="airlake-"))
        self.spark = spark
        self.root = f"{context.getCheckpointDir()}/tables"
        self.paths: set[str] = set()

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return the table that was written."""
        path = f"{self.root}/{uuid.uuid4().hex}"
        self.paths.add(path)
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            path.getFileSystem(conf).delete(path, True)
            self.paths.discard(table._scratch_path)

    def sweep(self) -> None:
        """Let Spark delete the shuffle files of written tables: it does so once the driver's JVM has collected their plans.

        Spark's listeners hold the last plan for a moment longer.
        """
        for _ in range(2):
            time.sleep(0.5)
            self.spark.sparkContext._jvm.System.gc()

    def close(self) -> None:
        """Delete every table that is left; results that read them must have been written before."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in sorted(self.paths):
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
        self.paths.clear()


def lean(df: DataFrame) -> DataFrame:
    """``df``, for a stage in Python: Arrow batches of its session are lowered to 8 MB and 4,000 rows, where they are larger.

    A worker and the executor's direct memory hold a few batches at once; long texts fill the default of 64 MB.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.max"
    size = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(name + "BytesPerBatch"))
    if not 0 < size <= 8 << 20:
        conf.set(name + "BytesPerBatch", str(8 << 20))
    if not 0 < int(conf.get(name + "RecordsPerBatch")) <= 4000:
        conf.set(name + "RecordsPerBatch", "4000")
    return df


def slices(batch: pa.RecordBatch, limit: int = 2_000_000, rows: int = 10_000, column: str = "text"):
    """Parts of a batch, without a copy, whose texts hold about ``limit`` bytes: what a task has as Python objects at once."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, before + limit, side="right"))))
        yield batch.slice(start, stop - start)
        start = stop


def empty_if_null(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """The evaluation fold: documents whose id, as text, has a CRC-32 divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: Edges that one task unites on its own.
EDGES = 500_000


def _forest(edges: DataFrame, most: int) -> DataFrame:
    """(u, v) with v < u: in every partition, each node with the least node that the partition's edges lead it to."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches):
        parent: dict = {}

        def find(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        def found():
            pairs = [(x, r) for x in list(parent) if (r := find(x)) != x]
            parent.clear()
            for k in range(0, len(pairs), 50_000):
                some = pairs[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in some], types[i]) for i in (0, 1)], ["u", "v"])

        types = None
        for batch in batches:
            types = types or [batch.column(c).type for c in ("u", "v")]
            for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > 2 * most:  # memory; the forest so far and the next one are tied by the later rounds
                yield from found()
        if parent:
            yield from found()

    return edges.select("u", "v").mapInArrow(run, f"u {kind}, v {kind}")


def _stars(edges: DataFrame) -> bool:
    """Whether every node points to one node at most, which points to none."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    )
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR out = 1 AND into = 1").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 100, per_task: int = EDGES) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``, root being the least node it reaches.

    Tasks of about ``per_task`` edges unite what they hold to a forest each. While these forests are not yet stars
    around the roots, alternating large-star and small-star rounds follow (Kiveris et al., 2014): two grouped
    minima each, written so that the partitions of the two joins with them can be split. Labels never leave the
    executors. A null end makes no edge. An empty input gives an empty table.
    """
    start = scratch.keep(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    )
    parts = max(1, -(-start.count() // per_task))
    current = scratch.keep(_forest(start.coalesce(parts), per_task))
    scratch.drop(start)
    rounds = 0
    # What one task united is made of stars.
    while parts > 1 and not _stars(current):
        rounds += 1
        if rounds > max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = scratch.keep(
            both.where("v > u").join(low, "u").where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        floor = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (
            large.join(floor, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(floor.select("u", F.col("m").alias("v")))
            .distinct()
        )
        united = scratch.keep(small)
        after = scratch.keep(_forest(united.coalesce(parts), per_task))
        scratch.drop(current, low, large, floor, united)
        current = after
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def tune_bands(threshold: float, rows: int, miss: float) -> int:
    """Bands of ``rows`` values each that lose at most a ``miss`` share of pairs at the threshold."""
    bands, left = 1, 1 - threshold**rows
    while left > miss:
        bands, left = bands + 1, left * (1 - threshold**rows)
    return bands
