"""Codes of vectors: each of four parts is the index of the nearest entry of a codebook, found by vector-approximation filtering.

Components are whole numbers, floor(scale * x), and all distances are exact. A codebook is filtered as a VA-file: every
coordinate of its entries is cut into cells of a few bits, and a part that looks for its nearest entry makes one table for each
coordinate, with the least and greatest squared difference to anything in each cell. Their sums over the coordinates bound the
distance to every entry from below and above. Only entries whose lower bound doesn't exceed the least upper bound are compared
by whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixspark.llm import vectors as V
from helixspark.llm.textkit import list_parts

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Bits of a cell.
BITS = 4
#: Largest component that 64-bit whole numbers are used for: squares of differences then add up in 64 bits over 4096 coordinates.
NARROW = 1 << 24
#: Parts that are compared with a codebook at a time; bounds the memory of their tables and bounds.
ROWS = 2048
LARGEST = (1 << 63) - 1


def whole_numbers(values: np.ndarray, scale: int, wide: bool) -> np.ndarray:
    """floor(scale * x): 64-bit, or Python's integers where ``wide`` is set, which hold every finite double's."""
    if not wide:
        return np.floor(values * scale).astype(np.int64)
    return np.array([math.floor(x * scale) if abs(x) < 2.0**52 else int(x) * scale for x in values.ravel().tolist()], dtype=object).reshape(values.shape)


class Filtered:
    """A codebook as a VA-file: entries (n, width), their cells, and each cell's bounds by coordinate."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries, n = entries, len(entries)
        self.compared = self.asked = 0
        cells = min(1 << bits, max(1, n))
        place = np.argsort(np.argsort(entries, axis=0, kind="stable"), axis=0, kind="stable")
        self.cell = (place * cells // max(1, n)).astype(np.int64)
        kind = entries.dtype
        self.low = np.zeros((cells, entries.shape[1]), kind)
        self.high = np.zeros((cells, entries.shape[1]), kind)
        for c in range(cells):
            inside = self.cell == c
            for d in range(entries.shape[1]):
                own = entries[inside[:, d], d]
                self.low[c, d], self.high[c, d] = own.min(), own.max()

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row (ties to the lower one) and the squared distance."""
        index, distance = np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype)
        for at in range(0, len(x), ROWS):
            index[at : at + ROWS], distance[at : at + ROWS] = self._nearest(x[at : at + ROWS])
        return index, distance

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = np.zeros((len(x), len(self.entries)), x.dtype)
        most = np.zeros((len(x), len(self.entries)), x.dtype)
        for d in range(x.shape[1]):
            below, above = self.low[:, d] - x[:, d, None], x[:, d, None] - self.high[:, d]
            gap = np.maximum(np.maximum(below, above), 0)
            far = np.maximum(np.abs(below), np.abs(above))
            least += np.take(gap * gap, self.cell[:, d], axis=1)
            most += np.take(far * far, self.cell[:, d], axis=1)
        row, entry = np.nonzero(least <= most.min(axis=1)[:, None])
        self.asked += least.size
        self.compared += len(row)
        apart = x[row] - self.entries[entry]
        square = (apart * apart).sum(axis=1) if x.shape[1] else np.zeros(len(row), x.dtype)
        # candidates stand by row, then entry: the first of a row's least is the lowest index
        first = np.concatenate(([0], np.flatnonzero(np.diff(row)) + 1)) if len(row) else np.zeros(0, np.int64)
        best = np.minimum.reduceat(square, first) if len(row) else square
        hit = np.flatnonzero(square == np.repeat(best, np.diff(np.append(first, len(row)))))
        pick = hit[np.unique(row[hit], return_index=True)[1]]
        return entry[pick], square[pick]


def _padded(column: pa.Array, width: int) -> np.ndarray:
    """Lists of doubles as rows of ``width``, zeros after a shorter list's end."""
    offsets, values = list_parts(column)
    n = np.diff(offsets)
    out = np.zeros((len(n), width))
    out[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = values.to_numpy(zero_copy_only=False).astype(np.float64)
    return out


@dataclass
class Coder:
    """Codebooks, part by part (entries, width), of whole numbers; what they need to code a vector."""

    books: list[np.ndarray]
    width: int
    wide: bool
    scale: int = SCALE
    filtered: list[Filtered] = field(default_factory=list)

    def assign(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(part, its whole numbers, nearest entries, squared distances) of a column of vectors."""
        self.filtered = self.filtered or [Filtered(b) for b in self.books]
        x = whole_numbers(_padded(column, self.width), self.scale, self.wide)
        step = self.width // len(self.books)
        for p, book in enumerate(self.filtered):
            own = x[:, p * step : (p + 1) * step]
            yield p, own, *book.nearest(own)

    def text(self) -> str:
        """All components in decimal by part, entry and position, comma-joined."""
        return ",".join(str(v) for b in self.books for v in b.ravel().tolist())


def _sums(coder: Coder):
    """Maps batches of vectors to one row (part, entry, n, sums) for each entry that the task's parts are nearest to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(len(b), np.int64) for b in coder.books]
        total = [np.zeros_like(b) for b in coder.books]
        for batch in batches:
            for p, own, entry, _ in coder.assign(batch.column("vector")):
                np.add.at(total[p], entry, own)
                count[p] += np.bincount(entry, minlength=len(count[p]))
        rows = [(p, int(e), int(count[p][e]), [str(v) for v in total[p][e].tolist()]) for p in range(len(count)) for e in np.flatnonzero(count[p])]
        schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, schema.types, strict=True)], schema=schema)

    return run


def _mean(rows: pa.Table) -> pa.Table:
    """The new entry of one (part, entry): its parts' sums over their number, rounded down. One row for each task that met it."""
    n = sum(rows.column("n").to_pylist())
    sums = [sum(map(int, column)) for column in zip(*rows.column("sums").to_pylist())]
    return pa.table({"part": rows.column("part")[:1], "entry": rows.column("entry")[:1], "mean": pa.array([[str(s // n) for s in sums]], pa.list_(pa.string()))})


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Coder | None:
    """Codebooks of a table (id, vector); None if it has no rows.

    They start as the parts of the ``entries`` rows with the smallest ids (ties by vector, null ids last). Each round is one job
    over all rows: tasks send sums for at most parts * entries entries, which are added up by entry. Only the codebooks, whose
    size doesn't depend on the number of rows, reach the driver.
    """
    size = vectors.agg(F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x))))).first()
    if size[0] is None:
        return None
    width = -(-size[0] // parts) * parts
    wide = (size[1] or 0) * scale >= NARROW or width > 4096
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow()
    start = whole_numbers(_padded(first.column("vector").combine_chunks(), width), scale, wide)
    coder = Coder([start[:, p * (width // parts) : (p + 1) * (width // parts)] for p in range(parts)], width, wide, scale)
    for _ in range(rounds):
        found = vectors.select("vector").mapInArrow(_sums(coder), "part int, entry int, n long, sums array<string>")
        books = [b.copy() for b in coder.books]
        for r in found.groupBy("part", "entry").applyInArrow(_mean, "part int, entry int, mean array<string>").collect():
            books[r["part"]][r["entry"]] = [int(v) for v in r["mean"]]
        coder = Coder(books, width, wide, scale)
    return coder


def encode(vectors: DataFrame, coder: Coder) -> DataFrame:
    """(id, label, code, error) of (id, vector, label): code holds one byte for each part, error is the squared distance to the entries, at most the largest 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(coder.assign(batch.column("vector")))
            code = np.stack([entry for _, _, entry, _ in found], axis=1).astype(np.uint8)
            error = [min(LARGEST, v) for v in sum(d for *_, d in found).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error, pa.int64())], names=["id", "label", "code", "error"])

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.select("id", "label", "vector").mapInArrow(run, f"id long, label {label}, code binary, error long")


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, vector, label) of the rows that take part."""
    return vectors.where(F.col(vector_col).isNotNull() & ((F.size(vector_col) == 0) | V.whole(F.col(vector_col)))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Coder | None]:
    """(id, label, code, error) of every row that takes part, and the codebooks.

    Rows whose vector is null or holds null or non-finite components are left out. Rows with a null or repeated id are coded like
    others. A vector shorter than the longest one, or of a length that parts don't divide, counts as if zeros followed. An empty
    table gives an empty one and no codebooks. The table is read ``rounds`` + 3 times and not copied. ``entries`` is 256 at most.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code holds one byte for each part: entries must be between 1 and 256")
    rows = usable(vectors, id_col, vector_col, label_col)
    coder = fit(rows, parts, entries, rounds, scale)
    if coder is None:
        return rows.select("id", "label", F.lit("").cast("binary").alias("code"), F.lit(0).cast("long").alias("error")).where("false"), None
    return encode(rows, coder), coder


def decode(codes: DataFrame, coder: Coder) -> DataFrame:
    """Adds ``vector``: the entries that a code names, one after another, over the scale."""
    books = [F.array(*(F.array(*(F.lit(v / coder.scale) for v in e)) for e in b.tolist())) for b in coder.books]
    byte = lambda p: F.conv(F.hex(F.substring("code", p + 1, 1)), 16, 10).cast("int")
    return codes.withColumn("vector", F.concat(*(F.get(b, byte(p)) for p, b in enumerate(books))))


def total_by_label(codes: DataFrame, name: str = "label_error", share: int = 1000) -> DataFrame:
    """Adds the sum of error over all rows of the same label, null labels together; at most the largest 64-bit number.

    Sums are made before the shuffle. Those of labels with more than 1 / ``share`` of all rows, fewer than ``share`` of them, are
    broadcast; only the other rows are shuffled to meet theirs.
    """
    n = codes.count()
    sums = codes.groupBy(F.col("label").alias("_label")).agg(F.count("*").alias("_n"), F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long").alias(name))
    hot, cold = (sums.where(f"_n * {share} {c} {n}").drop("_n") for c in (">", "<="))
    same = F.col("label").eqNullSafe(F.col("_label"))
    often = codes.join(F.broadcast(hot), same)
    rest = codes.join(F.broadcast(hot), same, "left_anti").join(cold.hint("merge"), same)
    return often.unionByName(rest).drop("_label")
