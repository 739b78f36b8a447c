"""Annual archives, CSV files in ZIP, as a data source: ``spark.read.format("zipped_csv")``."""

from __future__ import annotations

import zipfile
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from airlake.sources.files import Draft, listed, opened

#: Columns of the archives and how they are called here.
DAILY = {
    "State Code": "state_code", "County Code": "county_code", "Site Num": "site_num", "POC": "poc", "Latitude": "lat", "Longitude": "lon",
    "Sample Duration": "sample_duration", "Date Local": "date_local", "Event Type": "event_type", "Observation Count": "obs_count",
    "Observation Percent": "obs_percent", "Arithmetic Mean": "arithmetic_mean", "Local Site Name": "site_name",
}
HOURLY = {
    "State Code": "state_code", "County Code": "county_code", "Site Num": "site_num", "POC": "poc", "Date GMT": "date_gmt", "Time GMT": "time_gmt",
    "Sample Measurement": "sample_measurement",
}
KINDS = {"daily": DAILY, "hourly": HOURLY}
NUMBERS = {"poc": "int", "obs_count": "int", "lat": "double", "lon": "double", "obs_percent": "double", "arithmetic_mean": "double", "sample_measurement": "double"}
#: Bytes of text that are parsed at once, unless a row is longer. Arrow reads many such blocks ahead, so a task holds a multiple of this.
BLOCK = 1 << 20


@dataclass
class Member(InputPartition):
    """One CSV file of one archive."""

    archive: str
    name: str


@dataclass
class Written(WriterCommitMessage):
    draft: Draft | None


class ArchiveReader(DataSourceReader):
    """A partition for each CSV file in each archive, read as a stream; rows of states that are not asked for end in the task that parses them."""

    def __init__(self, path: str, columns: dict[str, str]):
        self.path, self.columns, self.only = path, columns, None

    def pushFilters(self, filters):
        """Equality and membership of the state's code are taken over; everything else is left to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("state_code",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = values if self.only is None else self.only & values
            else:
                yield f

    def partitions(self):
        fs, files = listed(self.path, "*.zip")
        found = []
        for file in files:  # only the directory at an archive's end is read here
            with fs.open_input_file(file.path) as handle, zipfile.ZipFile(handle) as archive:
                found += [Member(file.path, n) for n in archive.namelist() if n.lower().endswith(".csv")]
        # A source needs a partition even where there is nothing to read.
        return found or [Member("", "")]

    def _batches(self, fs, partition):
        """The file's rows as text; where a row is longer than a block, the file is opened anew with larger blocks and goes on behind the rows that are out."""
        options = csv.ConvertOptions(include_columns=list(self.columns), column_types=dict.fromkeys(self.columns, pa.string()), null_values=[""], strings_can_be_null=True)
        block, out = BLOCK, 0
        while True:
            # Spark has a task for each core; threads of Arrow's own would hold a parsed block for each core in every task.
            reading, skip = csv.ReadOptions(block_size=block, use_threads=False), out
            try:
                with fs.open_input_file(partition.archive) as handle, zipfile.ZipFile(handle) as archive, archive.open(partition.name) as text:
                    for batch in csv.open_csv(text, reading, csv.ParseOptions(newlines_in_values=True), options):
                        passed = min(skip, batch.num_rows)
                        skip -= passed
                        if passed < batch.num_rows:
                            yield batch.slice(passed)
                            out += batch.num_rows - passed
                return
            except pa.ArrowInvalid as e:
                if "straddl" not in str(e) or block >= 1 << 30:
                    raise
                block *= 8

    def read(self, partition):
        if not partition.archive:
            return
        fs = opened(self.path)[0]
        for batch in self._batches(fs, partition):
            if self.only is not None:
                batch = batch.filter(pc.is_in(batch.column("State Code"), pa.array(sorted(v for v in self.only if v is not None), pa.string())))
            for start in range(0, batch.num_rows, 20_000):
                part = batch.slice(start, 20_000)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in self.columns], list(self.columns.values()))


class ArchiveWriter(DataSourceArrowWriter):
    """An archive of one CSV file for each partition; archives get their names when all tasks have ended, and go when one fails."""

    def __init__(self, path: str, columns: dict[str, str]):
        self.path, self.columns = path, columns

    def write(self, iterator):
        from pyspark import TaskContext

        number, draft, out = TaskContext.get().partitionId(), None, None
        draft = Draft(self.path, f"part-{number:05}.zip")
        rows = 0
        with draft.fs.open_output_stream(draft.hidden) as handle, zipfile.ZipFile(handle, "w", zipfile.ZIP_DEFLATED) as archive:
            with archive.open(f"part-{number:05}.csv", "w", force_zip64=True) as text:
                for batch in iterator:
                    named = pa.RecordBatch.from_arrays([batch.column(c) for c in self.columns.values()], list(self.columns))
                    out = out or csv.CSVWriter(text, named.schema)
                    out.write_batch(named)
                    rows += batch.num_rows
                if out:
                    out.close()
        if not rows:
            draft.drop()
        return Written(draft if rows else None)

    def commit(self, messages):
        for message in messages:
            if message and message.draft:
                message.draft.move()

    def abort(self, messages):
        for message in messages:
            if message and message.draft:
                message.draft.drop()


class ZippedCsv(DataSource):
    """Options: path (a folder, a file, or a path with *) and kind (daily or hourly). All columns are text."""

    @classmethod
    def name(cls):
        return "zipped_csv"

    def _columns(self) -> dict[str, str]:
        return KINDS[self.options["kind"]]

    def schema(self):
        return ", ".join(f"{c} string" for c in self._columns().values())

    def reader(self, schema):
        return ArchiveReader(self.options["path"], self._columns())

    def writer(self, schema, overwrite):
        return ArchiveWriter(self.options["path"], self._columns())


def _read(spark: SparkSession, path: str, kind: str, states: list[str] | None) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # else Spark refuses sources that take filters
    spark.dataSource.register(ZippedCsv)
    rows = spark.read.format("zipped_csv").option("kind", kind).load(path)
    if states is not None:
        rows = rows.where(F.col("state_code").isin(*states))
    typed = {c: F.col(c).cast(t) for c, t in NUMBERS.items() if c in rows.columns}
    if kind == "daily":
        typed["date_local"] = F.to_date("date_local")
    return rows.withColumns(typed)


def read_daily_archives(spark: SparkSession, path: str, states: list[str] | None = None) -> DataFrame:
    """Raw daily readings of all archives below ``path``, of the given states (codes as they are written there) or all. Empty fields are null; columns come
    by name in any order, others are not converted; a missing one is an error. An archive may hold several CSV files; other files in it are passed over."""
    return _read(spark, path, "daily", states)


def read_hourly_archives(spark: SparkSession, path: str, states: list[str] | None = None) -> DataFrame:
    """Raw hourly readings, as ``read_daily_archives``."""
    return _read(spark, path, "hourly", states)


def write_archives(readings: DataFrame, path: str, kind: str) -> None:
    """Readings as archives below ``path``, one for each partition that has rows; they appear together when all are whole."""
    readings.sparkSession.dataSource.register(ZippedCsv)
    text = readings.select(*[F.col(c).cast("string") for c in KINDS[kind].values()])
    text.write.format("zipped_csv").option("kind", kind).mode("append").save(path)
