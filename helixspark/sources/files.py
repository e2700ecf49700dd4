"""Files that Spark has no reader for: Arrow streams and files, read by ranges of record batches, and shards of tokens as NPZ, a task each. What a task holds is one batch or one shard."""

from __future__ import annotations

import io
import posixpath
import struct
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from helixspark.operators.columns import TEXT_COLUMNS
from helixspark.sources.ranges import open_uri as _open

SHARD = "sample_id string, gene_ids array<int>, bin_ids array<smallint>, lengths smallint, domain_id int, text_data array<string>"
#: Rows of a batch that a reader hands on.
ROWS = 1000
#: Bytes of record batches that a task reads.
TASK_BYTES = 64 << 20
#: Kinds of messages in an Arrow stream.
DICTIONARY, RECORDS = 2, 3


def files_of(spark: SparkSession, folder: str, suffix: str = ".arrow") -> DataFrame:
    """The files of a folder, a task each; their contents aren't read here."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).load(folder).select("path")
    n = found.count()
    if not n:
        raise FileNotFoundError(f"no *{suffix} under {folder}")
    return found.repartition(n, "path")


def _field(message: bytes, table: int, number: int) -> int | None:
    """Where a field of a flat-buffer table stands, None if it isn't there."""
    (back,) = struct.unpack_from("<i", message, table)
    (size,) = struct.unpack_from("<H", message, table - back)
    at = 4 + 2 * number
    (offset,) = struct.unpack_from("<H", message, table - back + at) if at < size else (0,)
    return table + offset if offset else None


def _messages(file: pa.NativeFile) -> Iterator[tuple[int, int, int, int]]:
    """(kind, first byte, byte after it, rows) of each message of an Arrow stream; bodies are skipped, not read."""
    at, size = 0, file.size()
    while at + 4 <= size:
        (n,) = struct.unpack("<i", file.read_at(4, at))
        head = 4
        if n == -1:  # the marker that newer writers put before the length
            (n,), head = struct.unpack("<i", file.read_at(4, at + 4)), 8
        if n == 0:
            return
        message = file.read_at(n, at + head)
        (root,) = struct.unpack_from("<I", message, 0)
        kind, told, body = (_field(message, root, k) for k in (1, 2, 3))
        length = struct.unpack_from("<q", message, body)[0] if body else 0
        rows = 0
        if kind and told and message[kind] == RECORDS:
            table = told + struct.unpack_from("<I", message, told)[0]
            count = _field(message, table, 0)
            rows = struct.unpack_from("<q", message, count)[0] if count else 0
        yield message[kind] if kind else 0, at, at + head + n + length, rows
        at += head + n + length


def arrow_index(paths: DataFrame) -> DataFrame:
    """(path, stream, head, low, high, bytes, rows) of each record batch of Arrow files: its bytes in a stream, where head is the end of the schema and dictionaries; its number in a file with a footer, where rows isn't known. A file's task reads headers only."""
    kind = "path string, stream boolean, head long, low long, high long, bytes long, rows long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                system, path = _open(uri)
                found = []
                with system.open_input_file(path) as file:
                    if file.read(6) == b"ARROW1":
                        n = pa.ipc.open_file(file).num_record_batches
                        found = [(uri, False, 0, i, i + 1, file.size() // n, None) for i in range(n)]
                    else:
                        head = None
                        for what, low, high, rows in _messages(file):
                            if what == RECORDS:
                                head = low if head is None else head
                                found.append((uri, True, head, low, high, high - low, rows))
                            elif what == DICTIONARY and head is not None:
                                raise ValueError(f"{uri} replaces a dictionary at byte {low}")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [()] * 7, (pa.string(), pa.bool_(), *[pa.int64()] * 5), strict=True)], names=["path", "stream", "head", "low", "high", "bytes", "rows"])

    return paths.mapInArrow(run, kind)


class _Part(io.RawIOBase):
    """The first ``head`` bytes of a file, then those from low to high, as one stream."""

    def __init__(self, file: pa.NativeFile, head: int, low: int, high: int):
        self.file, self.ranges = file, [(0, head), (low, high)]

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while self.ranges and self.ranges[0][0] >= self.ranges[0][1]:
            self.ranges.pop(0)
        if not self.ranges:
            return 0
        low, high = self.ranges[0]
        got = self.file.read_at(min(len(buffer), high - low), low)
        buffer[: len(got)] = got
        self.ranges[0] = (low + len(got), high)
        return len(got)


def _range(uri: str, stream: bool, head: int, low: int, high: int, fields: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """Record batches of a range, one at a time, of the named fields."""
    system, path = _open(uri)
    options = pa.ipc.IpcReadOptions(included_fields=list(fields))
    with system.open_input_file(path) as file:
        if stream:
            yield from pa.ipc.open_stream(io.BufferedReader(_Part(file, head, low, high)), options=options)
        else:
            reader = pa.ipc.open_file(file, options=options)
            for i in range(low, high):
                yield reader.get_batch(i)


def read_arrow(spark: SparkSession, folder: str, columns: Sequence[str] | None = None, suffix: str = ".arrow", task_bytes: int = TASK_BYTES) -> DataFrame:
    """All rows of a folder's Arrow files, as data set libraries save them; only ``columns``, which must be there, if given.

    Record batches are found by their headers, and tasks read about ``task_bytes`` of them each, so one large file is dealt over
    many tasks. Other columns of a batch are passed over.
    """
    paths = files_of(spark, folder, suffix)
    system, path = _open(paths.agg({"path": "min"}).first()[0])
    with system.open_input_file(path) as file:
        head = file.read(6)
        file.seek(0)
        schema = (pa.ipc.open_file(file) if head == b"ARROW1" else pa.ipc.open_stream(file)).schema
    missing = sorted(set(columns or ()) - set(schema.names))
    if missing:
        raise ValueError(f"{folder} lacks the columns {', '.join(missing)}")
    names = list(columns or schema.names)
    value = lambda kind: kind.value_type if pa.types.is_dictionary(kind) else kind
    plain = pa.schema([pa.field(c, value(schema.field(c).type)) for c in names])
    before = F.sum("bytes").over(W.partitionBy("path").orderBy("low").rowsBetween(W.unboundedPreceding, -1))
    piece = F.floor(F.coalesce(before, F.lit(0)) / task_bytes).alias("piece")
    pieces = arrow_index(paths).select("*", piece).groupBy("path", "stream", "head", "piece").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    n = max(1, pieces.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                system, path = _open(r["path"])
                with system.open_input_file(path) as file:
                    own = (pa.ipc.open_stream if r["stream"] else pa.ipc.open_file)(file).schema
                fields = [own.get_field_index(c) for c in names]
                if -1 in fields:
                    raise ValueError(f"{r['path']} lacks the columns {', '.join(c for c, f in zip(names, fields, strict=True) if f < 0)}")
                for got in _range(r["path"], r["stream"], r["head"], r["low"], r["high"], sorted(set(fields))):
                    cells = [got.column(c) for c in names]
                    yield pa.RecordBatch.from_arrays([c.dictionary_decode() if pa.types.is_dictionary(c.type) else c for c in cells], names=names)

    return pieces.drop("piece").repartitionByRange(n, "path", "low").mapInArrow(run, from_arrow_schema(plain))


def write_shards(rows: DataFrame, folder: str) -> list[str]:
    """One NPZ file a shard_id, of rows as ``expression.with_shards`` numbers them; returns the names of the files, in order.

    Texts are stored as fixed-width strings, so that reading them needs no pickle. A file gets its name when it is whole; a task
    that runs again replaces it by an equal one. Rows of a shard are in the order of sample_id.
    """

    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("sample_id")
        flat = lambda c, kind: np.array(shard[c].to_pylist(), kind)
        out = io.BytesIO()
        np.savez_compressed(out, sample_id=flat("sample_id", str), gene_ids=flat("gene_ids", np.int32), bin_ids=flat("bin_ids", np.int16), lengths=flat("lengths", np.int16), domain_id=flat("domain_id", np.int32), text_data=flat("text_data", str), text_cols=np.array(TEXT_COLUMNS))
        number = shard["shard_id"][0].as_py()
        system, base = _open(folder)
        system.create_dir(base)
        name, part = f"shard_{number:05d}.npz", posixpath.join(base, f".{uuid.uuid4().hex}.part")
        with system.open_output_stream(part) as file:
            file.write(out.getbuffer())
        system.move(part, posixpath.join(base, name))
        return pa.table({"shard_id": pa.array([number], pa.int64()), "name": [name]})

    made = rows.selectExpr("cast(shard_id as long) shard_id", "cast(sample_id as string) sample_id", "gene_ids", "bin_ids", "lengths", "domain_id", "text_data")
    return [r["name"] for r in made.groupBy("shard_id").applyInArrow(run, "shard_id long, name string").orderBy("shard_id").collect()]


def read_shards(spark: SparkSession, folder: str, allow_pickle: bool = False) -> DataFrame:
    """Rows of all NPZ shards of a folder. ``allow_pickle`` reads shards whose texts are pickled objects: only for files that you trust."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                system, path = _open(uri)
                with system.open_input_file(path) as file, np.load(file, allow_pickle=allow_pickle) as shard:
                    held = {c: shard[c] for c in ("sample_id", "gene_ids", "bin_ids", "lengths", "domain_id", "text_data")}
                    for a in range(0, len(held["sample_id"]), ROWS):
                        cut = {c: v[a : a + ROWS] for c, v in held.items()}
                        yield pa.RecordBatch.from_arrays([pa.array(list(map(str, cut["sample_id"])), pa.string()), pa.array(list(cut["gene_ids"].astype(np.int32)), pa.list_(pa.int32())), pa.array(list(cut["bin_ids"].astype(np.int16)), pa.list_(pa.int16())), pa.array(cut["lengths"].astype(np.int16)), pa.array(cut["domain_id"].astype(np.int32)), pa.array([list(map(str, t)) for t in cut["text_data"]], pa.list_(pa.string()))], list(held))

    return files_of(spark, folder, ".npz").mapInArrow(run, SHARD)
