"""Arrays on disk that tasks read by byte ranges: sparse matrices as CSR triples, dense rows, and vectors of fixed length.

Files are NumPy's (.npy), raw little-endian numbers, or a zip file with one stored array, as tensors are saved. The driver reads
headers and file lengths only. Paths are URIs that ``pyarrow.fs`` opens, on the driver and on executors.
"""

from __future__ import annotations

import posixpath
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Stored values of a sparse matrix, and bytes of a dense one, that a task reads unless told otherwise.
VALUES, BYTES = 4_000_000, 64 << 20
#: Values of a batch, and places of the row pointer that are read at a time.
BATCH, POINTERS = 1 << 16, 1 << 14


def open_uri(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, and the path in it; Spark writes file:/a where file:///a is meant."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = f"file://{uri[5:]}"
    return fs.FileSystem.from_uri(uri)


@dataclass
class Stored:
    """An array in a file: type, shape (rows, and columns if there are two) and first byte."""

    uri: str
    dtype: np.dtype
    shape: tuple[int, ...]
    start: int

    @property
    def stride(self) -> int:
        return self.dtype.itemsize * (self.shape[1] if len(self.shape) > 1 else 1)

    def read(self, file: pa.NativeFile, low: int, high: int) -> np.ndarray:
        """Rows low to high, and no other byte."""
        got = np.frombuffer(file.read_at((high - low) * self.stride, self.start + low * self.stride), self.dtype)
        return got.reshape((high - low, *self.shape[1:]))


def stored(uri: str, dtype: str | None = None, width: int | None = None) -> Stored:
    """What a file holds. A .npy file says so itself; others need ``dtype`` and ``width``, and their length gives the number of rows."""
    system, path = open_uri(uri)
    with system.open_input_file(path) as file:
        head = file.read(6)
        file.seek(0)
        if head == b"\x93NUMPY":
            version = np.lib.format.read_magic(file)
            shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(file)
            if by_column and len(shape) > 1:
                raise ValueError(f"{uri} is stored column by column")
            if kind.hasobject or len(shape) not in (1, 2):
                raise ValueError(f"{uri} isn't a list or a table of numbers")
            return Stored(uri, kind, shape, file.tell())
        if dtype is None or width is None:
            raise ValueError(f"{uri} has no header: give its dtype and width")
        kind, start, size = np.dtype(dtype).newbyteorder("<"), 0, file.size()
        if head[:4] == b"PK\x03\x04":
            with zipfile.ZipFile(file) as z:
                entries = [e for e in z.infolist() if e.filename.rpartition("/")[0].endswith("data")]
            if len(entries) != 1 or entries[0].compress_type != zipfile.ZIP_STORED:
                raise ValueError(f"{uri} doesn't hold one stored array")
            local = file.read_at(30, entries[0].header_offset)
            start = entries[0].header_offset + 30 + int.from_bytes(local[26:28], "little") + int.from_bytes(local[28:30], "little")
            size = entries[0].file_size
    if width < 1 or size % (kind.itemsize * width):
        raise ValueError(f"{uri}: {size} bytes aren't rows of {width} numbers of type {dtype}")
    return Stored(uri, kind, (size // (kind.itemsize * width), width), start)


@dataclass
class Range(InputPartition):
    low: int
    high: int


def _cut(low: int, high: int, most: int) -> list[Range]:
    """Equal ranges of at most ``most``."""
    n = max(1, -(-(high - low) // max(1, most)))
    return [Range(low + (high - low) * i // n, low + (high - low) * (i + 1) // n) for i in range(n)]


def _rows(options: dict, n: int) -> tuple[int, int]:
    """The rows low to high that are asked for: option rows, as low:high, either may be missing."""
    low, _, high = options.get("rows", ":").partition(":")
    low, high = int(low or 0), int(high or n)
    return min(max(0, low), n), min(max(low, high), n)


class CsrReader(DataSourceReader):
    """Ranges of stored values, not of rows: a row of any length is dealt over as many tasks as its values need."""

    def __init__(self, options: dict):
        at = lambda name: posixpath.join(options["path"], options.get(name, f"{name}.npy"))
        self.pointer, self.columns, self.data = (stored(at(n)) for n in ("indptr", "indices", "data"))
        if self.columns.shape != self.data.shape or len(self.pointer.shape) != 1:
            raise ValueError(f"{options['path']} has {self.columns.shape} indices and {self.data.shape} values")
        self.low, self.high = _rows(options, max(0, self.pointer.shape[0] - 1))
        self.most = int(options.get("values", VALUES))

    def partitions(self) -> list[Range]:
        if self.pointer.shape[0] == 0:
            return [Range(0, 0)]
        system, path = open_uri(self.pointer.uri)
        with system.open_input_file(path) as file:
            low, high = (int(self.pointer.read(file, i, i + 1)[0]) for i in (self.low, self.high))
        return _cut(low, high, self.most)

    def _row_of(self, file: pa.NativeFile, value: int) -> int:
        """The row that holds a stored value: the last whose pointer isn't beyond it. Bisects the file, a block of pointers at the end."""
        low, high = self.low, self.high
        while high - low > POINTERS:
            mid = (low + high) // 2
            if self.pointer.read(file, mid, mid + 1)[0] <= value:
                low = mid
            else:
                high = mid
        return low + int(np.searchsorted(self.pointer.read(file, low, high + 1), value, "right")) - 1

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        at, end = partition.low, partition.high
        if at >= end:
            return
        opened = [open_uri(a.uri) for a in (self.pointer, self.columns, self.data)]
        pointer, columns, data = (system.open_input_file(path) for system, path in opened)
        with pointer, columns, data:
            first = self._row_of(pointer, at)
            while at < end:
                if first >= self.high:
                    raise ValueError(f"{self.pointer.uri} ends before value {at}")
                ends = self.pointer.read(pointer, first, min(first + POINTERS, self.high) + 1).astype(np.int64)
                stop = min(end, int(ends[-1]))
                while at < stop:
                    to = min(stop, at + BATCH)
                    row = first + np.searchsorted(ends, np.arange(at, to), "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(self.columns.read(columns, at, to).astype(np.int64)), pa.array(self.data.read(data, at, to).astype(np.float64))], names=["row", "col", "value"])
                    at = to
                first += len(ends) - 1


class CsrRows(DataSource):
    """(row, col, value) of the stored values of a CSR matrix: a folder with indptr.npy, indices.npy and data.npy. Options: rows (low:high), values (of a task), and names of the files."""

    @classmethod
    def name(cls) -> str:
        return "csr_rows"

    def schema(self) -> str:
        return "row long, col long, value double"

    def reader(self, schema) -> CsrReader:
        return CsrReader(dict(self.options))


class DenseReader(DataSourceReader):
    def __init__(self, options: dict):
        self.array = stored(options["path"], options.get("dtype"), int(options["width"]) if "width" in options else None)
        if len(self.array.shape) != 2:
            raise ValueError(f"{options['path']} isn't a table of rows")
        self.low, self.high = _rows(options, self.array.shape[0])
        self.most = max(1, int(options.get("bytes", BYTES)) // max(1, self.array.stride))

    def partitions(self) -> list[Range]:
        return _cut(self.low, self.high, self.most)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, path = open_uri(self.array.uri)
        step, kind = max(1, (BATCH * 8) // max(1, self.array.stride)), np.float32 if self.array.dtype.itemsize <= 4 and self.array.dtype.kind == "f" else np.float64
        with system.open_input_file(path) as file:
            for a in range(partition.low, partition.high, step):
                b = min(partition.high, a + step)
                values = self.array.read(file, a, b).astype(kind)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), lists], names=["row", "values"])


class DenseRows(DataSource):
    """(row, values) of a dense table of numbers, rows dealt to tasks by bytes. Options: rows (low:high), bytes (of a task); dtype and width of a file without a header."""

    @classmethod
    def name(cls) -> str:
        return "dense_rows"

    def schema(self) -> str:
        kind = stored(self.options["path"], self.options.get("dtype"), int(self.options["width"]) if "width" in self.options else None).dtype
        return f"row long, values array<{'float' if kind.kind == 'f' and kind.itemsize <= 4 else 'double'}>"

    def reader(self, schema) -> DenseReader:
        return DenseReader(dict(self.options))


def read_csr(spark: SparkSession, folder: str, rows: tuple[int, int] | None = None, values: int = VALUES) -> DataFrame:
    """(row, col, value) of a CSR matrix, or of its rows low to high; nothing but these rows' values is read."""
    spark.dataSource.register(CsrRows)
    return _load(spark.read.format("csr_rows").option("values", values), folder, rows)


def read_dense(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, dtype: str | None = None, width: int | None = None, bytes_of_task: int = BYTES) -> DataFrame:
    """(row, values) of a dense table, or of its rows low to high; nothing but these rows is read."""
    spark.dataSource.register(DenseRows)
    reader = spark.read.format("dense_rows").option("bytes", bytes_of_task)
    for name, value in (("dtype", dtype), ("width", width)):
        reader = reader if value is None else reader.option(name, value)
    return _load(reader, path, rows)


def _load(reader, path: str, rows: tuple[int, int] | None) -> DataFrame:
    return (reader if rows is None else reader.option("rows", f"{rows[0]}:{rows[1]}")).load(path)
