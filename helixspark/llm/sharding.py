"""Shards of near-equal bytes by histogram sort."""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixspark.llm.shared import staged

_TOP = 1 << 64


def _cells(hi: np.ndarray, lo: np.ndarray, p_hi: np.ndarray, p_lo: np.ndarray) -> np.ndarray:
    """How many probes are at most each key; keys and probes are pairs of 64-bit words."""
    at = np.searchsorted(p_hi, hi, "left")
    same = np.flatnonzero(at < len(p_hi))
    same = same[p_hi[at[same]] == hi[same]]
    if len(same):
        order = same[np.argsort(hi[same], kind="stable")]
        edges = np.flatnonzero(np.concatenate(([True], np.diff(hi[order]) != 0, [True])))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            rows = order[a:b]
            left, right = at[rows[0]], np.searchsorted(p_hi, hi[rows[0]], "right")
            at[rows] = left + np.searchsorted(p_lo[left:right], lo[rows], "right")
    return at


def _assign(probes: list[int]):
    """mapInArrow function: (hi, lo, ...) with a first column ``cell``."""
    p_hi = np.array([p >> 64 for p in probes], np.uint64)
    p_lo = np.array([p & (_TOP - 1) for p in probes], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hi, lo = (b.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            cell = pa.array(_cells(hi, lo, p_hi, p_lo).astype(np.int64))
            yield pa.RecordBatch.from_arrays([cell, *b.columns], ["cell", *b.schema.names])

    return run


def _histogram(keys: DataFrame, probes: list[int]) -> dict[int, tuple[int, int]]:
    """Exact bytes and rows in each cell between consecutive probes; one row a task and cell is shuffled."""
    assign = _assign(probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for b in assign(batches):
            cell = b.column(0).to_numpy()
            np.add.at(size, cell, b.column(3).to_numpy())
            np.add.at(rows, cell, 1)
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some.astype(np.int64), size[some], rows[some])], ["cell", "size", "rows"])

    got = keys.mapInArrow(run, "cell long, size long, rows long").groupBy("cell").agg(F.sum("size"), F.sum("rows")).collect()
    return {r[0]: (r[1], r[2]) for r in got}


class Histogram:
    """Probes with exact bytes and rows below each; the first and last are the ends of the key space."""

    def __init__(self, size: int, rows: int):
        self.keys, self.size, self.rows = [0, 1 << 128], [0, size], [0, rows]

    def add(self, keys: DataFrame, probes: list[int]) -> None:
        fresh = sorted(set(probes) - set(self.keys))
        inner = sorted({*self.keys[1:-1], *fresh})
        cells = _histogram(keys, inner)
        size = rows = 0
        out = [(0, 0, 0)]
        for i, p in enumerate(inner):
            a, b = cells.get(i, (0, 0))
            size, rows = size + a, rows + b
            out.append((p, size, rows))
        out.append((self.keys[-1], self.size[-1], self.rows[-1]))
        self.keys, self.size, self.rows = map(list, zip(*out, strict=True))


def _cuts(a: int, b: int, n: int) -> list[int]:
    """About ``n`` keys evenly inside (a, b): whole high words while there are any, so that equal texts stay together; then low words."""
    span = (b - 1 >> 64) - (a >> 64)
    if span:
        return sorted({k << 64 for j in range(1, n + 1) if a < (k := (a >> 64) + max(1, span * j // n)) << 64 < b})
    return sorted({k for j in range(1, n + 1) if a < (k := a + (b - a) * j // (n + 1)) < b})


def fill(sizes: list[int], atoms: list[tuple[int, int]], total: int) -> tuple[dict[int, int], list[int]]:
    """Shards of groups that stay whole (key, size), and the bytes of all others that each shard takes, so that shards come out level.

    The largest group goes first, each to the shard with the fewest bytes, ties to the lower number; ``sizes`` are the shards' bytes so far.
    """
    loads, where = [(s, k) for k, s in enumerate(sizes)], {}
    heapq.heapify(loads)
    for key, size in sorted(atoms, key=lambda x: (-x[1], x[0])):
        load, k = heapq.heappop(loads)
        where[key] = k
        heapq.heappush(loads, (load + size, k))
    own = [load for load, _ in sorted(loads, key=lambda x: x[1])]
    rest, order = total - sum(s for _, s in atoms), sorted(own)
    level, n = 0.0, len(order)
    for i in range(1, n + 1):  # the level of the i lowest, if it stays below the next one
        level = (rest + sum(order[:i])) / i
        if i == n or level <= order[i]:
            break
    want = [max(0.0, level - s) for s in own]
    cuts = [round(sum(want[: k + 1])) for k in range(n)]
    cuts[-1] = rest
    return where, [y - x for x, y in zip([0, *cuts[:-1]], cuts, strict=True)]


def splitters(keys: DataFrame, total: int, rows: int, goals: list[int], slack: int, group: int, fan: int) -> list[int]:
    """Keys at which the bytes below reach the goals: probes are refined until each is within ``slack`` of its goal.

    Each round counts exact bytes below all probes; then every interval that holds an unmet goal gets ``fan`` more probes,
    and all others lose theirs, so that there are as many as goals and ``fan`` allow, whatever the size of the table. A
    goal is also met where its interval holds one row, one key, or equal texts of at most ``group`` bytes.
    """
    h = Histogram(total, rows)
    n = (len(goals) + 1) * fan
    probes = [((1 << 64) * i // n) << 64 for i in range(1, n)]
    while probes:
        h.add(keys, probes)
        todo = set()
        for g in goals:
            i = bisect.bisect_left(h.size, g)
            if i and min(h.size[i] - g, g - h.size[i - 1]) > slack and h.rows[i] - h.rows[i - 1] > 1:
                a, b = h.keys[i - 1], h.keys[i]
                if not (a & (_TOP - 1) == 0 and (b - 1 >> 64) == (a >> 64) and h.size[i] - h.size[i - 1] <= group):
                    todo.add(i - 1)
        probes = [p for i in sorted(todo) for p in _cuts(h.keys[i], h.keys[i + 1], fan)]
        if probes:
            ends = {0, len(h.keys) - 1, *(j for g in goals if (i := bisect.bisect_left(h.size, g)) for j in (i - 1, i))}
            h.keys, h.size, h.rows = ([x[j] for j in sorted(ends)] for x in (h.keys, h.size, h.rows))
    chosen = [0]
    for g in goals:
        i = bisect.bisect_left(h.size, g)
        i = i if i == 0 or h.size[i] - g <= g - h.size[i - 1] else i - 1
        chosen.append(max(chosen[-1], i))
    return [h.keys[i] for i in chosen[1:]]


def shard(docs: DataFrame, shards: int = 40, tolerance: float = 0.005, atom: float = 0.05, fan: int = 16, cell_rows: int = 50_000, seed: int = 29, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Put every row in one of ``shards`` shards of nearly equal bytes; equal texts stay together where they fit a shard.

    A row weighs the UTF-8 bytes of its text and 16 more. Groups of equal texts (a text that occurs once among them) above
    ``atom`` of a shard, at most ``shards`` / ``atom`` of them, are placed whole, the largest first; all other rows are sorted by a hash of the text and then one of doc_id
    and cut where shards come out level. Only a group larger than a shard is cut itself: it can't stay in one of
    near equal sizes. Keys and sizes are written once; histogram
    rounds read only them, and send one row for each task and cell between probes. A shard's rows are dealt to cells of
    about ``cell_rows`` by hash; counts of cells, summed up in Spark, give each cell's first slot, and one exchange by cell
    places all rows. Edges are within ``tolerance`` of a shard's bytes from their goals, or half of a group below ``atom``; shards
    are level but for that, unless whole groups, or texts larger than a shard, fill some beyond the level.

    Returns doc_id, size, text_crc32 (null for a null text), law ("bytes"), shard, slot (from 0 in each shard, without
    gaps), grown_shard (null), and the columns of ``keep``. Null texts weigh 16 and are one group; null ids are allowed;
    rows with equal id and text get neighbouring slots where their group isn't cut; an empty table gives an empty one.
    """
    text = docs[text_col]
    hi = F.xxhash64(F.lit(seed), text)
    lo = F.xxhash64(F.lit(seed), docs[id_col], text)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16
    slim = docs.select(hi.alias("hi"), lo.alias("lo"), size.alias("size"), docs[id_col].cast("long").alias("doc_id"), F.crc32(text.cast("binary")).alias("text_crc32"), *(docs[c].alias(c) for c in keep if c not in ("doc_id", "size", "text_crc32")))
    slim = staged(slim, "shard")
    # signed words in the order of unsigned ones aren't needed: any fixed order will do, and numpy reads them unsigned
    keys = slim.select("hi", "lo", "size")
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("size")).first()
    slack = max(1, int(tolerance * total / shards))
    limit = max(slack, int(atom * total / shards))
    groups = slim.groupBy("hi").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where(f"bytes > {limit} and (bytes * {shards} <= {total} or n = 1)")
    atoms = [(r[0], r[1]) for r in groups.select("hi", "bytes").collect()]  # at most shards / atom
    whole, share = fill([0] * shards, atoms, total)
    if whole:
        keys = keys.join(F.broadcast(groups.select("hi")), "hi", "left_anti")
    left, cut_rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("size")).first() if whole else (total, rows)
    goals = list(accumulate(share))[:-1]
    edges = splitters(keys, left, cut_rows, goals, slack, limit, fan) if cut_rows else [0] * (shards - 1)
    unique = sorted(set(edges))
    assign = _assign(unique)
    # equal edges leave the shards between them empty
    shard_of = np.array([0, *(bisect.bisect_right(edges, e) for e in unique)], np.int32)
    cells = max(1, -(-rows // (shards * cell_rows)))

    atom_keys = np.array(sorted(whole), np.int64)
    atom_shards = np.array([whole[k] for k in sorted(whole)], np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in assign(batches):
            own = shard_of[b.column(0).to_numpy()]
            if len(atom_keys):
                hi = b.column(1).to_numpy()
                at = np.minimum(np.searchsorted(atom_keys, hi), len(atom_keys) - 1)
                own = np.where(atom_keys[at] == hi, atom_shards[at], own)
            yield pa.RecordBatch.from_arrays([pa.array(own), *b.columns[1:]], ["shard", *b.schema.names[1:]])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema)
    placed = slim.mapInArrow(run, f"shard int, {fields}").withColumn("cell", F.pmod(F.xxhash64("hi", "lo"), F.lit(cells)))
    placed = staged(placed, "placed")
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    first = counts.select("shard", "cell", (F.sum("n").over(W.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("first"))
    order = W.partitionBy("shard", "cell").orderBy("hi", "lo", "doc_id", "text_crc32", "size")
    slot = F.col("first") + F.row_number().over(order) - 1
    return placed.join(first, ["shard", "cell"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *(c for c in keep if c not in ("doc_id", "size", "text_crc32")))
