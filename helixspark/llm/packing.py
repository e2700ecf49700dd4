"""Bounded-space online packing of token sequences into fixed windows."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixspark.llm import bpe, textkit
from helixspark.llm.shared import staged

COLUMNS = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, open boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())])


class _Windows:
    """At most ``most`` open windows; what is placed stays in memory only while its window is open."""

    def __init__(self, size: int, most: int, first: int):
        self.size, self.most, self.next = size, most, first
        self.free: list[tuple[int, int]] = []  # (room, sequence id), sorted
        self.rows: dict[int, list[tuple]] = {}

    def place(self, row: tuple, length: int) -> list[tuple]:
        """Best fit: the open window with the least room that suffices; the fullest goes if none has it. Returns rows of finished windows."""
        done: list[tuple] = []
        at = bisect.bisect_left(self.free, (length, -1))
        if at < len(self.free):
            room, sid = self.free.pop(at)
        else:
            if len(self.free) >= self.most:
                done += self._close(self.free.pop(0)[1], False)
            room, sid = self.size, self.next
            self.next += 1
            self.rows[sid] = []
        self.rows[sid].append((*row, sid, self.size - room))
        if room == length:
            return done + self._close(sid, False)
        bisect.insort(self.free, (room - length, sid))
        return done

    def _close(self, sid: int, is_open: bool) -> list[tuple]:
        return [(*r, is_open) for r in self.rows.pop(sid)]

    def rest(self) -> list[tuple]:
        return [r for _, sid in self.free for r in self._close(sid, True)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def _merge_plan(window: int):
    def run(table: pa.Table) -> pa.Table:
        sids, fills = table["sequence_id"].to_pylist(), table["fill"].to_pylist()
        order = sorted(range(len(sids)), key=lambda i: (-fills[i], sids[i]))
        free: list[tuple[int, int]] = []
        out = []
        for i in order:
            at = bisect.bisect_left(free, (fills[i], -(1 << 62)))
            room, into = free.pop(at) if at < len(free) else (window, sids[i])
            out.append((sids[i], into, window - room))
            if room > fills[i]:
                bisect.insort(free, (room - fills[i], into))
        a, b, c = zip(*out, strict=True)
        return pa.table({"sequence_id": pa.array(a, pa.int64()), "into": pa.array(b, pa.int64()), "base": pa.array(c, pa.int64())})

    return run


def pack(docs: DataFrame, vocabulary: str, window: int = 1024, open_windows: int = 64, end_id: int = 0, group: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``window`` tokens.

    A document is its token ids and then ``end_id``. In each partition, full windows of a long document go out at once;
    what remains is placed best-fit among ``open_windows`` open windows, and the fullest goes out when none fits. Windows
    still open at the end are merged best-fit-decreasing in groups of about ``group`` windows. Pieces, with their ids as
    little-endian unsigned 32-bit binary, are made for parts of a batch of bounded size and written once to the shared folder: lost executors cost no second
    tokenization, and only lengths of open windows are shuffled. Returns per piece doc_id, start, length, ids,
    doc_tokens, sequence_id, offset. A null text is empty and still yields its end id; a null doc_id stays null; repeated
    rows are packed each; an empty table gives no piece; other columns are not read. Ties in room go to the older window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.byte_encoder(vocabulary)
        windows = _Windows(window, open_windows, TaskContext.get().partitionId() << 36)
        for big in batches:
            sizes = pc.fill_null(pc.binary_length(big.column(1)), 0).to_numpy(zero_copy_only=False)
            for first, last in textkit.chunks(sizes, 2 * textkit.CHUNK):
                b = big.slice(first, last - first)
                ids, offsets = encoder.encode(pc.fill_null(b.column(1), "").to_pylist())
                done: list[tuple] = []
                for doc, a, z in zip(b.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    own = np.append(ids[a:z], np.uint32(end_id)).astype("<u4")
                    n = len(own)
                    for start in range(0, n, window):
                        length = min(window, n - start)
                        done += windows.place((doc, start, length, own[start : start + length].tobytes(), n), length)
                    if len(done) >= 4096:
                        yield _batch(done)
                        done = []
                if done:
                    yield _batch(done)
        rest = windows.rest()
        if rest:
            yield _batch(rest)

    pieces = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, COLUMNS)
    placed = staged(pieces, "pack")
    left = placed.where("open").groupBy("sequence_id").agg(F.max(F.col("offset") + F.col("length")).alias("fill"))
    groups = max(1, -(-left.count() // group))
    plan = left.withColumn("g", F.pmod(F.xxhash64("sequence_id"), F.lit(groups))).groupBy("g").applyInArrow(_merge_plan(window), "sequence_id long, into long, base long")
    moved = placed.where("open").join(plan, "sequence_id").select("doc_id", "start", "length", "ids", "doc_tokens", F.col("into").alias("sequence_id"), (F.col("offset") + F.col("base")).alias("offset"))
    return placed.where("not open").drop("open").select(moved.columns).unionByName(moved)
