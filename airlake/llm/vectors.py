"""Vectors in tasks: which rows count, their components as integers, and sums over all tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components beyond this count as this, so that 1024 times them is a long.
LIMIT = 2.0**52
#: Numbers of one array that a task sends.
CHUNK = 64


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose embedding is there and holds finite numbers only."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.coalesce(finite, F.lit(False)))


def integers(column: pa.Array, width: int) -> np.ndarray:
    """floor(1024 x) of the components of usable vectors; shorter vectors end in zeros."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    flat = np.floor(np.clip(flat, -LIMIT, LIMIT) * 1024).astype(np.int64)
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def parcel(keys: list[tuple], rows, names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    """What a task has summed: integer keys and, for each, an array, cut into pieces of ``CHUNK``."""
    cut = [(key, c, row[c : c + CHUNK]) for key, row in zip(keys, rows, strict=True) for c in range(0, len(row), CHUNK)]
    columns = [pa.array([key[k] for key, _, _ in cut], pa.int64()) for k in range(len(names))]
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array([c for _, c, _ in cut], pa.int64()), pa.array([list(row) for _, _, row in cut], pa.list_(kind))], [*names, "at", "s"]
    )


def schema(names: list[str], kind: str) -> str:
    return ", ".join([*(f"{n} bigint" for n in names), "at bigint", f"s array<{kind}>"])


def summed(parcels: DataFrame, names: list[str], width: int) -> dict[tuple, list]:
    """The parcels' sums by key. Tasks send one row for each key and piece, executors add them up, and the driver gets one array for each key."""
    sums = [F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(min(CHUNK, width))]
    found: dict[tuple, list] = {}
    for row in parcels.groupBy(*names, "at").agg(*sums).orderBy("at").collect():
        k = len(names)
        found.setdefault(tuple(row[:k]), []).extend(x for x in row[k + 1 :] if x is not None)
    return found
