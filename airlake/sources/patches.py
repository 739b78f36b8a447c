"""Patch trees, <station>/<key>.npy, as a data source: ``spark.read.format("npy_patches")``."""

from __future__ import annotations

import posixpath
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from airlake.sources.files import Draft, listed, opened

#: The order of bands in patch files of the visible product and of all bands.
RGB = ["b4", "b3", "b2"]
ALL = ["b1", "b2", "b3", "b4", "b5", "b6", "b7", "b8", "b8a", "b9", "b10", "b11", "b12"]
#: Bytes of a patch that are read at once.
CHUNK = 4 << 20


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    drafts: list[Draft]


def header(handle) -> tuple[tuple[int, int, int], bool, np.dtype]:
    """(height, width, channels), whether the first axis runs fastest, and the type; the handle is left at the pixels."""
    version = np.lib.format.read_magic(handle)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, kind = read(handle)
    return (*shape, *[1] * (3 - len(shape))), fortran, kind


def planes(handle, at: list[int], rows: int | None = None) -> list[np.ndarray]:
    """The channels ``at`` of a patch, each flat and row by row, read ``rows`` image rows at a time; no other channel is converted."""
    (height, width, channels), fortran, kind = header(handle)
    if fortran:  # a channel is one stretch of the file
        start, size = handle.tell(), height * width * kind.itemsize
        out = []
        for k in at:
            handle.seek(start + k * size)
            out.append(np.frombuffer(handle.read(size), kind).reshape(width, height).T.ravel().astype(np.int32))
        return out
    rows = rows or max(1, CHUNK // max(1, width * channels * kind.itemsize))
    out = [np.empty(height * width, np.int32) for _ in at]
    for first in range(0, height, rows):
        n = min(rows, height - first)
        part = np.frombuffer(handle.read(n * width * channels * kind.itemsize), kind).reshape(n * width, channels)
        for plane, k in zip(out, at, strict=True):
            plane[first * width : (first + n) * width] = part[:, k]
    return out


class PatchReader(DataSourceReader):
    """A partition for every ``per_task`` files; for shapes alone only their headers are read."""

    def __init__(self, path: str, bands: list[str], order: list[str], per_task: int):
        self.path, self.bands, self.order, self.per_task = path, bands, order, per_task

    def partitions(self):
        paths = [f.path for f in listed(self.path, "*.npy")[1]]
        return [Files(paths[k : k + self.per_task]) for k in range(0, len(paths), self.per_task)] or [Files([])]

    def read(self, partition):
        fs = opened(self.path)[0]
        at = [self.order.index(b) for b in self.bands]
        for path in partition.paths:
            with fs.open_input_file(path) as handle:
                shape = header(handle)[0]
                if at and shape[2] != len(self.order):
                    raise ValueError(f"{path} has {shape[2]} bands, not the {len(self.order)} bands {', '.join(self.order)}")
                handle.seek(0)
                found = planes(handle, at) if at else []
            folder, name = posixpath.split(path)
            keys = [pa.array([v]) for v in (posixpath.basename(folder), name.removesuffix(".npy"))]
            sizes = [pa.array([s], pa.int32()) for s in shape]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(p)], pa.int32()), pa.array(p)) for p in found]
            yield pa.RecordBatch.from_arrays([*keys, *sizes, *lists], ["station_id", "key", "height", "width", "channels", *self.bands])


class PatchWriter(DataSourceArrowWriter):
    """A file for each row; files get their names when all tasks have ended, so a broken write leaves no half patches."""

    def __init__(self, path: str, order: list[str]):
        self.path, self.order = path, order

    def write(self, iterator):
        drafts = []
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    stack = np.stack([np.asarray(row[b], np.int64) for b in self.order], -1).reshape(row["height"], row["width"], len(self.order))
                    if stack.size and not 0 <= stack.min() <= stack.max() <= 65535:
                        raise ValueError(f"pixels of {row['station_id']}/{row['key']} are outside 0 to 65535")
                    draft = Draft(self.path, f"{row['station_id']}/{row['key']}.npy")
                    drafts.append(draft)
                    with draft.fs.open_output_stream(draft.hidden) as handle:
                        np.save(handle, stack.astype("uint16"))
        except Exception:
            for draft in drafts:
                draft.drop()
            raise
        return Written(drafts)

    def commit(self, messages):
        for message in messages:
            for draft in message.drafts if message else []:
                draft.move()

    def abort(self, messages):
        for message in messages:
            for draft in message.drafts if message else []:
                draft.drop()


class NpyPatches(DataSource):
    """Options: path, bands (names, comma between), order (of the bands in a file) and per_task (files that one task reads)."""

    @classmethod
    def name(cls):
        return "npy_patches"

    def _names(self, option: str) -> list[str]:
        return [b for b in self.options.get(option, "").split(",") if b]

    def schema(self):
        return ", ".join(["station_id string", "key string", "height int", "width int", "channels int", *(f"{b} array<int>" for b in self._names("bands"))])

    def reader(self, schema):
        return PatchReader(self.options["path"], self._names("bands"), self._names("order"), int(self.options.get("per_task", "64")))

    def writer(self, schema, overwrite):
        return PatchWriter(self.options["path"], self._names("order"))


def scan_patches(spark: SparkSession, root: str, bands: list[str] | None = None, order: list[str] = ALL, per_task: int = 64) -> DataFrame:
    """(station_id, key, height, width, channels) of the files <station>/<key>.npy below a folder, and for each of ``bands`` a flat column of its pixels, row by row.

    ``order`` names the channels of the files, which lie interleaved; channels that are not asked for are never made into numbers, and without ``bands`` no pixel is
    read. A file of another number of channels is an error. Hidden files, which a writer has not finished, are passed over; two-dimensional arrays have one channel.
    """
    if unknown := set(bands or []) - set(order):
        raise ValueError(f"no such bands: {sorted(unknown)}")
    spark.dataSource.register(NpyPatches)
    options = {"bands": ",".join(bands or []), "order": ",".join(order), "per_task": str(per_task)}
    return spark.read.format("npy_patches").options(**options).load(root)


def write_patches(patches: DataFrame, root: str, order: list[str] = ALL) -> None:
    """Rows of station_id, key, height, width and a column for each band of ``order`` as files of 16-bit pixels; all appear when the last is written."""
    patches.sparkSession.dataSource.register(NpyPatches)
    ready = patches.select("station_id", "key", "height", "width", *order)
    ready.write.format("npy_patches").options(order=",".join(order)).mode("append").save(root)
