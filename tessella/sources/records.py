"""Spark data sources for binary files: ``fixed_records`` reads and writes files of equal records of numbers in pieces, ``whole_files``
writes a file a row. Paths may be of any file system of Arrow that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe=":/@"))


def files_of(path: str) -> list[tuple[str, int]]:
    """Files of a folder by name, or one file, with their sizes; names that begin with a dot or an underscore don't count."""
    system, at = place(path)
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at))
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


@dataclass
class _Range(InputPartition):
    file: str
    first: int  # the range's first record in its file
    count: int
    row: int  # and in all files together


class _RecordReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.columns = options["path"], int(options["columns"])
        self.kind, self.scale, self.offset = np.dtype(options.get("dtype", "<i2")), float(options.get("scale", "1")), int(options.get("offset", "0"))
        self.piece = max(1, int(options.get("piece_bytes", str(8 << 20))) // (self.columns * self.kind.itemsize))
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if name != ("row",) or not isinstance(value, int) or not isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                yield f
                continue
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                top = value + (not isinstance(f, LessThan))
                self.high = top if self.high is None else min(self.high, top)

    def partitions(self):
        out, row, size = [], 0, self.columns * self.kind.itemsize
        for file, length in files_of(self.path):
            n = max(0, length - self.offset) // size
            if (length - self.offset) % size:
                raise ValueError(f"{file} does not hold whole records of {size} bytes")
            first, last = max(0, self.low - row), n if self.high is None else min(n, self.high - row)
            out += [_Range(file, i, min(self.piece, last - i), row + i) for i in range(first, last, self.piece)]
            row += n
        return out or [_Range("", 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        size, step = self.columns * self.kind.itemsize, max(1, (1 << 20) // (self.columns * 8))
        with place(self.path)[0].open_input_file(partition.file) as f:
            for i in range(0, partition.count, step):
                n = min(step, partition.count - i)
                f.seek(self.offset + (partition.first + i) * size)
                values = np.frombuffer(f.read(n * size), self.kind).astype(float) * self.scale
                rows = pa.array(partition.row + i + np.arange(n))
                yield pa.RecordBatch.from_arrays([rows, pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * self.columns), pa.array(values))], ["row", "values"])


@dataclass
class _Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class _RecordWriter(DataSourceArrowWriter):
    """A task writes its rows, which must be in order and without gaps, under a hidden name; at commit files get the number of their
    first row as a name, so that all files in order are the table in order."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.columns, self.kind, self.scale = int(options["columns"]), np.dtype(options.get("dtype", "<i2")), float(options.get("scale", "1"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, at = place(self.path)
        system.create_dir(at, recursive=True)
        hidden, first, expected = f"{at}/.{uuid.uuid4().hex}", None, None
        out = None
        for batch in iterator:
            rows, values = batch.column("row").to_numpy(), batch.column("values")
            if not len(rows):
                continue
            if (np.diff(values.offsets.to_numpy()) != self.columns).any() or values.null_count:
                raise ValueError(f"a record does not hold {self.columns} values")
            first = int(rows[0]) if first is None else first
            if not np.array_equal(rows, np.arange(len(rows)) + (rows[0] if expected is None else expected)):
                raise ValueError("rows of a task must be in order and without gaps")
            expected = int(rows[-1]) + 1
            raw = values.flatten().to_numpy(zero_copy_only=False) / self.scale
            if self.kind.kind in "iu":
                whole, range_ = np.rint(raw), np.iinfo(self.kind)
                if not ((whole >= range_.min) & (whole <= range_.max)).all():
                    raise ValueError(f"a value does not fit {self.kind}")
                raw = whole
            out = out or system.open_output_stream(hidden)
            out.write(raw.astype(self.kind).tobytes())
        if out is None:
            return _Written([])
        out.close()
        return _Written([(hidden, f"{at}/part-{first:020d}")])

    def commit(self, messages: list[_Written | None]) -> None:
        system, at = place(self.path)
        system.create_dir(at, recursive=True)
        if self.overwrite:
            for file, _ in files_of(self.path):
                system.delete_file(file)
        for m in messages:
            for hidden, name in m.moves if m else ():
                system.move(hidden, name)

    def abort(self, messages: list[_Written | None]) -> None:
        system, _ = place(self.path)
        for m in messages:
            for hidden, _ in m.moves if m else ():
                system.delete_file(hidden)


class FixedRecords(DataSource):
    """Records of ``columns`` numbers of ``dtype`` after ``offset`` bytes of each file, times ``scale``: ``(row, values)``. Row numbers go on
    from file to file, in order of names. Files are read by ranges of records, of which conditions on ``row`` leave out what they can."""

    @classmethod
    def name(cls) -> str:
        return "fixed_records"

    def schema(self) -> str:
        return "row long, values array<double>"

    def reader(self, schema) -> _RecordReader:
        return _RecordReader(self.options)

    def writer(self, schema, overwrite: bool) -> _RecordWriter:
        return _RecordWriter(self.options, overwrite)


class _FileWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, at = place(self.path)
        made = set()
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if name is None or content is None:
                    raise ValueError("a file needs a name and a content")
                folder = f"{at}/{name}".rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{at}/{name}") as f:
                    f.write(content)
        return _Written([])


class WholeFiles(DataSource):
    """Writes each row ``(name, content)`` as a file of its own below the path. A task that runs again writes the same files again."""

    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> _FileWriter:
        return _FileWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes both sources known to a session, and lets conditions reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FixedRecords)
    spark.dataSource.register(WholeFiles)


def write_files(files: DataFrame, path: str) -> None:
    """``files(name, content)`` to a file a row."""
    register(files.sparkSession)
    files.selectExpr("cast(name as string) as name", "cast(content as binary) as content").write.format("whole_files").mode("append").save(path)


def write_records(rows: DataFrame, path: str, columns: int, dtype: str = "<i2", scale: float = 1.0, mode: str = "append") -> None:
    """``rows(row, values)``, numbered without gaps, to files of fixed records, dealt to tasks by ranges of rows."""
    register(rows.sparkSession)
    dealt = rows.selectExpr("cast(row as long) as row", "cast(values as array<double>) as values").repartitionByRange("row").sortWithinPartitions("row")
    dealt.write.format("fixed_records").options(columns=columns, dtype=dtype, scale=scale).mode(mode).save(path)


def read_records(spark: SparkSession, path: str, columns: int, dtype: str = "<i2", scale: float = 1.0, offset: int = 0, piece_bytes: int = 8 << 20) -> DataFrame:
    register(spark)
    return spark.read.format("fixed_records").options(columns=columns, dtype=dtype, scale=scale, offset=offset, piece_bytes=piece_bytes).load(path)
