"""CSV in zip archives as a Spark data source (A2).

Zip is not a Hadoop codec, so Spark's own readers can't open it.  ``zipcsv``
reads archives through Spark's Python data source API: one partition for each
member, streamed through the decompressor and the CSV parser, so memory is
bounded by a batch of rows whatever the size of the member.  Fields may hold
line ends and doubled quotes; an empty field without quotes is null, one in
quotes is the empty string, or null as well with ``empty_as_null`` (as for
Spark's CSV reader).
"""

from __future__ import annotations

import csv
import io
import sys
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import importable

ROWS = 4096   # rows of a batch


def _open(path: str):
    """(file system, path in it) of a path or URI that every executor sees."""
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "", 1) if path.startswith("file:") else path)


class _File(io.RawIOBase):
    """An Arrow file for ``zipfile``, which expects OSError for a place that
    is not in the file."""

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.file.read(len(into))
        into[:len(data)] = data
        return len(data)

    def seek(self, offset: int, whence: int = 0) -> int:
        try:
            return self.file.seek(offset, whence)
        except pa.ArrowInvalid as e:
            raise OSError(str(e)) from e

    def tell(self) -> int:
        return self.file.tell()


def _archive(file: pa.NativeFile) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BufferedReader(_File(file), 1 << 20))


def archives(paths: str) -> list[str]:
    """The archives of a comma-separated list of files and folders."""
    out = []
    for path in paths.split(","):
        system, inner = _open(path)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.Directory:
            prefix = path.rstrip("/")
            out += sorted(f"{prefix}/{f.base_name}" for f in system.get_file_info(fs.FileSelector(inner)) if f.base_name.endswith(".zip"))
        elif info.type == fs.FileType.File:
            out.append(path)
        else:
            raise FileNotFoundError(path)
    return out


def members(path: str) -> list[str]:
    system, inner = _open(path)
    with system.open_input_file(inner) as f, _archive(f) as z:
        return [m.filename for m in z.infolist() if not m.is_dir()]


def records(path: str, member: str) -> Iterator[list]:
    """Rows of a member, its header first."""
    csv.field_size_limit(sys.maxsize)   # fields of any length
    system, inner = _open(path)
    with system.open_input_file(inner) as f, _archive(f) as z, z.open(member) as raw:
        text = io.TextIOWrapper(raw, encoding="utf-8-sig", newline="")
        yield from csv.reader(text, quoting=csv.QUOTE_NOTNULL)


class Member(InputPartition):
    def __init__(self, path: str, member: str):
        super().__init__((path, member))
        self.path, self.member = path, member


class ZipCsvReader(DataSourceReader):
    def __init__(self, schema: T.StructType, paths: str):
        self.names, self.paths = schema.names, paths

    def partitions(self) -> list[Member]:
        return [Member(p, m) for p in archives(self.paths) for m in members(p)] or [Member("", "")]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        schema = pa.schema([(n, pa.string()) for n in self.names])
        rows = records(partition.path, partition.member)
        header = next(rows, None)
        if header is None:
            return
        place = {name: i for i, name in enumerate(header)}
        at = [place.get(n) for n in self.names]   # by name; a column that a member lacks is null

        def batch(held):
            return pa.RecordBatch.from_arrays([pa.array([None if i is None or i >= len(r) else r[i] for r in held], pa.string()) for i in at], schema=schema)
        held = []
        for row in rows:
            if row:   # not a blank line
                held.append(row)
            if len(held) == ROWS:
                yield batch(held)
                held = []
        if held:
            yield batch(held)


class ZipCsvSource(DataSource):
    """``spark.read.format("zipcsv").option("path", ...)``: string columns,
    named by the first member's header unless a schema is given."""

    @classmethod
    def name(cls) -> str:
        return "zipcsv"

    def schema(self) -> T.StructType:
        for path in archives(self.options["path"]):
            for m in members(path):
                header = next(records(path, m), None)
                if header:
                    return T.StructType([T.StructField(n, T.StringType()) for n in header])
        raise ValueError("no member with a header: give a schema")

    def reader(self, schema: T.StructType) -> ZipCsvReader:
        return ZipCsvReader(schema, self.options["path"])


def read_zip_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, empty_as_null: bool = False) -> DataFrame:
    """Rows of all members of an archive, or of the archives of a folder; the
    columns are cast to ``schema`` where it is given."""
    importable(spark)
    spark.dataSource.register(ZipCsvSource)
    reader = spark.read.format("zipcsv").option("path", path)
    text = schema and T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    rows = (reader.schema(text) if text else reader).load()
    if empty_as_null:
        rows = rows.select(*(F.nullif(F.col(c), F.lit("")).alias(c) for c in rows.columns))
    return rows if schema is None else rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))


def write_zip_csv(df: DataFrame, folder: str) -> None:
    """One archive of one member for each partition of ``df``.  A task that is
    run again replaces its archive; it appears under its name when complete."""
    importable(df.sparkSession)
    names = df.columns

    def run(batches):
        from pyspark import TaskContext

        ctx = TaskContext.get()
        system, inner = _open(folder)
        system.create_dir(inner, recursive=True)
        name, temp = f"part-{ctx.partitionId():06d}", f"{inner}/.{ctx.partitionId():06d}-{ctx.taskAttemptId()}"
        n = 0
        with system.open_output_stream(temp) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z, z.open(f"{name}.csv", "w", force_zip64=True) as raw:
            text = io.TextIOWrapper(raw, encoding="utf-8", newline="")
            rows = csv.writer(text, quoting=csv.QUOTE_NOTNULL, lineterminator="\n")
            rows.writerow(names)
            for b in batches:
                rows.writerows(zip(*(b.column(c).to_pylist() for c in names)))
                n += b.num_rows
            text.flush()
            text.detach()
        system.move(temp, f"{inner}/{name}.zip")
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})
    df.select(*(F.col(c).cast("string").alias(c) for c in names)).mapInArrow(run, "n bigint").agg(F.sum("n")).collect()   # one number
