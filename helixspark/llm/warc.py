"""WARC archives with a two-level capture index.

Records are gzip members of archives in the shared folder. The index holds one line for each record, sorted by
reversed-host URL key and cut into compressed blocks; a sparse directory keeps each block's first key and place. A
look-up searches the directory, then the block, and reads only the record's range.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.llm.shared import new_path, staged
from helixspark.operators.order import running

#: Payloads shorter than this are always written whole.
LEAST_SHARED = 100
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """Host labels reversed and comma-joined, a bracket, then port, path and query, in lower case; "" for null. What can't be parsed is its own key. Tabs, line ends and backslashes are escaped, so that keys sort as the index has them."""
    return _url_key(url).replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n")


def _url_key(url: str | None) -> str:
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    key = ",".join(reversed(host.removeprefix("www.").split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/")
    return (key + (f"?{parts.query}" if parts.query else "")).lower()


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _record(page: int | None, url: str | None, digest: str, refers: int | None, body: bytes) -> bytes:
    kind = "response" if refers is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http + (body if refers is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(member: bytes) -> dict:
    """A record's type, page ids, digest, payload size and payload (None for a revisit)."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    page = lambda x: None if x is None or x == "<urn:page:None>" else int(x[10:-1])
    kind = fields["WARC-Type"]
    return {"type": kind, "page": page(fields["WARC-Record-ID"]), "refers": page(fields.get("WARC-Refers-To")), "url": fields["WARC-Target-URI"], "digest": fields["WARC-Payload-Digest"].partition(":")[2], "bytes": length, "payload": body if kind == "response" else None}


def plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Each page's payload, digest, and for a revisit the page it refers to.

    Smallest ids of equal payloads are aggregated before the shuffle; only digests that occur more than once are joined back.
    """
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[html_col].cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    shared = rows.where(F.octet_length("payload") >= LEAST_SHARED).groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(shared, rows.digest == shared.d, "left").select("page_id", "url", "payload", "digest", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers"))


class Archive:
    """Archives and their two-level index under ``path``; ``directory`` is the sparse block directory."""

    def __init__(self, spark: SparkSession, path: str, directory: DataFrame):
        self.spark, self.path, self.directory = spark, path, directory

    def records(self) -> DataFrame:
        """All records, read back by way of the index: each task takes blocks of the directory, then reads the records' ranges."""
        n = max(1, self.spark.sparkContext.defaultParallelism * 2)
        schema = "url_key string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
        return self.directory.select("file", "offset", "length").repartition(n, "file", "offset").mapInArrow(_read_blocks, schema)

    def lookup(self, urls: DataFrame, url_col: str = "url", task_keys: int = 5000) -> DataFrame:
        """Records of the given URLs, a null one's too: every record of a key once, however often it is asked for.

        Keys and the directory's first and last keys are put in one order by range; counts of blocks that begin and end before a key
        give the blocks that can hold it, an equi-join by block number. Rows that ask for a block are dealt by (block, key) range, so
        that many keys of one block are several tasks' work, about ``task_keys`` each; a block is searched by bisection, then only matching records are read.
        """
        wanted = urls.select(urls[url_col].cast("string").alias("url")).mapInArrow(_keys, "want string").distinct()
        point = lambda df, key, tie, *more: df.select(F.lit(0).alias("g"), F.col(key).alias("key"), F.lit(tie).alias("tie"), *more)
        place = [F.col(c) for c in ("last_key", "file", "offset", "length")]
        none = [F.lit("").alias("last_key"), F.lit("").alias("file"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("length")]
        first, last, asked = point(self.directory, "first_key", 0, *place), point(self.directory, "last_key", 2, *place), point(wanted, "want", 1, *none)
        # begun blocks are counted in the lower half of a number, ended ones in the upper half
        amount = F.when(F.col("tie") == 0, F.lit(1)).when(F.col("tie") == 2, F.lit(1 << 31)).otherwise(F.lit(0)).cast("long")
        counted = running(first.unionByName(last).unionByName(asked).withColumn("n", amount), "g", ["key", "tie", "last_key", "file", "offset"], "n")
        counted = staged(counted.select("key", "tie", "file", "offset", "length", F.col("total").bitwiseAND(F.lit((1 << 31) - 1)).alias("begun"), F.shiftright("total", 31).alias("ended")), "places")
        blocks = counted.where("tie = 0").select((F.col("begun") - 1).alias("block"), "file", "offset", "length")
        near = counted.where("tie = 1 and begun > ended").select(F.col("key").alias("want"), F.explode(F.sequence(F.col("ended"), F.col("begun") - 1)).alias("block"))
        # rows are small, but each stands for records to be read: their number decides how many tasks there are
        parts = max(1, -(-counted.where("tie = 1").count() // task_keys))
        rows = near.join(blocks, "block").repartitionByRange(parts, "file", "offset", "want").sortWithinPartitions("file", "offset", "want")
        schema = "url_key string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
        return rows.select("file", "offset", "length", "want").mapInArrow(_read_blocks, schema)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in b.column(0).to_pylist()], pa.string())], ["want"])


_READ = pa.schema([("url_key", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def search(lines: list[bytes], key: str) -> range:
    """Places of the lines with this key in a sorted block, by bisection."""
    of = lambda line: line.split(b"\t", 1)[0]
    k = key.encode()
    return range(bisect.bisect_left(lines, k, key=of), bisect.bisect_right(lines, k, key=of))


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    opened: dict[str, object] = {}

    def get(path: str, offset: int, length: int) -> bytes:
        if path not in opened:
            if len(opened) >= 64:
                opened.pop(next(iter(opened))).close()
            fs, p = _open(path)
            opened[path] = fs.open_input_file(p)
        f = opened[path]
        f.seek(offset)
        return f.read(length)

    rows, held, block, whole = [], 0, None, []
    for b in batches:
        wanted = b.column("want").to_pylist() if "want" in b.schema.names else [None] * b.num_rows
        for path, offset, length, want in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), wanted, strict=True):
            if block != (path, offset):  # rows that ask for one block stand together
                block, whole = (path, offset), zlib.decompress(get(path, offset, length), 31).split(b"\n")[:-1]
            lines = whole if want is None else [whole[i] for i in search(whole, want)]
            for key, rest in (line.split(b"\t", 1) for line in lines):
                at = json.loads(rest)
                r = parse(get(at["f"], at["o"], at["n"]))
                if r["payload"] is not None and hashlib.sha256(r["payload"]).hexdigest() != r["digest"]:
                    raise OSError(f"a record of {at['f']} at {at['o']} doesn't match its digest")
                rows.append((key.decode(), r["page"], r["bytes"], r["digest"], r["type"], r["refers"], r["payload"]))
                held += len(r["payload"] or b"")
                if held > 8 << 20 or len(rows) >= 4096:
                    yield _rows(rows)
                    rows, held = [], 0
    if rows:
        yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _READ.types, strict=True)], schema=_READ)


def write(pages: DataFrame, path: str | None = None, block_lines: int = 3000, level: int = 3, index_rows: int = 500_000, **cols: str) -> Archive:
    """Write a record for every page, index them, and return the archive.

    ``path`` is a URI that pyarrow can open on every executor, by default in the shared folder. Each task streams one
    archive file named by partition and attempt, so a lost or repeated attempt leaves only an unreferenced file. Index
    lines are range-sorted by key in partitions of about ``index_rows`` and cut into blocks of ``block_lines``.

    A null html is an empty payload; of equal payloads of at least 100 bytes the smallest page_id is a response (all of
    its rows, if it is repeated), the others refer to it; a null page_id with such a payload is a response; null urls
    have key ""; an empty table gives an archive without blocks; other columns are not read.
    """
    spark = pages.sparkSession
    base = path or new_path(spark, "warc")
    fs, root = _open(base)
    fs.create_dir(root, recursive=True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{base}/part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        stream, at = None, 0
        for b in batches:
            if stream is None:
                fs, p = _open(name)
                stream = fs.open_output_stream(p, compression=None)
            out = []
            for page, url, body, digest, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                member = _gzip(_record(page, url, digest, refers, body), level)
                stream.write(member)
                out.append((url_key(url), name, at, len(member)))
                at += len(member)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["key", "file", "offset", "length"])
        if stream is not None:
            stream.close()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{base}/index-{context.partitionId():06d}-{context.taskAttemptId()}.gz"
        stream, at, lines, out = None, 0, [], []

        def end() -> None:
            nonlocal at, lines
            member = _gzip(b"\n".join(x[1] for x in lines) + b"\n", 6)
            stream.write(member)
            out.append((lines[0][0], lines[-1][0], name, at, len(member)))
            at, lines = at + len(member), []

        for b in batches:
            if stream is None:
                fs, p = _open(name)
                stream = fs.open_output_stream(p, compression=None)
            for key, file, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lines.append((key, key.encode() + b"\t" + json.dumps({"f": file, "o": offset, "n": length}).encode()))
                if len(lines) == block_lines:
                    end()
        if lines:
            end()
        if stream is not None:
            stream.close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["first_key", "last_key", "file", "offset", "length"])

    lines = staged(plan(pages, **cols).mapInArrow(put, "key string, file string, offset long, length long"), "captures")
    parts = max(1, -(-lines.count() // index_rows))
    ordered = lines.repartitionByRange(parts, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    directory = staged(ordered.mapInArrow(blocks, "first_key string, last_key string, file string, offset long, length long"), "directory")
    return Archive(spark, base, directory)
