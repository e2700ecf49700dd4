"""Approximate nearest neighbours by few stable projections, a kd-tree, and a chi-square stopping test."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixspark.llm import vectors as V
from helixspark.llm.shared import staged


def chi_square(x: np.ndarray, m: int) -> np.ndarray:
    """The distribution function with an even number m of degrees of freedom."""
    half = np.asarray(x) / 2
    return 1 - np.exp(-half) * sum(half**i / math.factorial(i) for i in range(m // 2))


def reach_of(sure: float, m: int) -> float:
    """Where ``chi_square`` reaches ``sure``, by bisection."""
    low, high = 0.0, 1000.0 * m
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < sure else (low, mid)
    return high


def directions(dim: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, dims))


class KdTree:
    """Median splits of the widest axis, as a heap; its leaves are cells of the whole space, so that any point has one."""

    def __init__(self, points: np.ndarray, levels: int):
        self.levels = levels
        self.axis, self.split = np.zeros(1 << levels, np.int64), np.zeros(1 << levels)
        rows = {1: np.arange(len(points))}
        for node in range(1, 1 << levels):
            own = rows.pop(node)
            axis = int(np.argmax(np.ptp(points[own], axis=0)))
            self.axis[node], self.split[node] = axis, np.median(points[own, axis])
            right = points[own, axis] >= self.split[node]
            rows[2 * node], rows[2 * node + 1] = (own[~right], own[right]) if right.any() and not right.all() else (own, own)

    def cells(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.levels):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] >= self.split[node])
        return node - (1 << self.levels)

    def boxes(self) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest coordinates of each cell, (cells, axes)."""
        dims = int(self.axis.max(initial=0)) + 1
        low, high = np.full((1, dims), -np.inf), np.full((1, dims), np.inf)
        for level in range(self.levels):
            nodes = np.arange(1 << level, 2 << level)
            low, high = np.repeat(low, 2, axis=0), np.repeat(high, 2, axis=0)
            left, right = 2 * np.arange(len(nodes)), 2 * np.arange(len(nodes)) + 1
            high[left, self.axis[nodes]] = np.minimum(high[left, self.axis[nodes]], self.split[nodes])
            low[right, self.axis[nodes]] = np.maximum(low[right, self.axis[nodes]], self.split[nodes])
        return low, high

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distance of each query to each cell, one axis after another."""
        low, high = self.boxes()
        out = np.zeros((len(q), len(low)))
        for d in range(low.shape[1]):
            gap = np.maximum(low[:, d] - q[:, d, None], q[:, d, None] - high[:, d])
            out += np.maximum(gap, 0, out=gap) ** 2
        return out


def verify(q: np.ndarray, x: np.ndarray, ids: np.ndarray, best: V.Best, dims: int, sure: float, seed: int, leaf: int = 32) -> float:
    """Fill ``best`` with cosines of unit vectors of one block; returns the share of pairs that were verified.

    Every query meets the leaves of the block's projected kd-tree in its own order, the nearest first, as an incremental search
    does, in steps of 1, 1, 2, 4 and so on leaves; before each step the chi-square test, on its kth best so far, stops it or lets it
    go on, and bounds which leaves of the step it still meets. Of a leaf only those points are verified that the test doesn't stop before.
    """
    base, far = directions(q.shape[1], dims, seed), reach_of(sure, dims)
    pq, px = q @ base, x @ base
    tree = KdTree(px, max(0, math.ceil(math.log2(max(1, len(x) / leaf)))))
    cells = tree.cells(px)
    order = np.argsort(cells, kind="stable")
    at = np.searchsorted(cells[order], np.arange((1 << tree.levels) + 1))
    gaps, q2, x2 = tree.distances(pq), (pq**2).sum(axis=1), (px**2).sum(axis=1)
    gaps[:, np.diff(at) == 0] = np.inf
    verified = 0

    def meet(rows: np.ndarray, cell: int, limit: np.ndarray) -> None:
        nonlocal verified
        own = order[at[cell] : at[cell + 1]]
        a, b = np.nonzero(q2[rows][:, None] - 2 * pq[rows] @ px[own].T + x2[own] < limit[:, None] + 1e-9)
        score = np.full((len(rows), len(own)), -np.inf)
        score[a, b] = np.einsum("ij,ij->i", q[rows[a]], x[own[b]])
        best.add(rows, score, ids[own])
        verified += len(a)

    own = np.argsort(gaps, axis=1, kind="stable")
    rows, place, step = np.arange(len(q)), 0, 1
    while len(rows) and place < own.shape[1]:
        kth = best.worst()[rows]
        limit = np.where(np.isfinite(kth), far * np.maximum(2 - 2 * kth, 1e-12), np.inf)
        near = np.take_along_axis(gaps[rows], own[rows, place : place + step], 1)
        rows, limit, near = rows[go := near[:, 0] < limit], limit[go], near[go]
        i, j = np.nonzero(near < limit[:, None])
        cell = own[rows, place : place + step][i, j]
        by = np.argsort(cell, kind="stable")
        for some in np.split(by, np.flatnonzero(np.diff(cell[by])) + 1) if len(by) else []:
            meet(rows[i[some]], int(cell[some[0]]), limit[i[some]])
        place, step = place + step, max(1, place)
    return verified / max(1, len(q) * len(x))


def nearest(table: DataFrame, queries: Column, k: int = 5, dims: int = 16, sure: float = 0.98, cell_rows: int = 4096, block_rows: int = 8192, query_rows: int = 4096, sample_rows: int = 16384, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k nearest by cosine: (query_id, rank, vec_id, score).

    Unit vectors are projected on ``dims`` (even) Gaussian directions. For unit vectors squared distance is 2 - 2 cos, and
    squared projected over squared true distance is chi-square with ``dims`` degrees of freedom: a query is done with all
    cells whose projected distance is so large that a point as near as its kth best would be met before with probability
    ``sure``. A kd-tree over the projections, fitted once on at most ``sample_rows`` rows, deals all rows to cells. Each query
    searches its own cell first; that gives its kth best, and the test then tells which other cells it goes to. There, a
    smaller kd-tree and the same test decide what is verified, by exact cosine in double precision.

    Cells of more than ``block_rows`` rows are cut, as are their queries; at most two thousand cells are fitted, and what is
    sent to executors is their splits. Vectors that are null, empty, zero, or hold null or non-finite components take no
    part, nor do null ids; lengths are searched apart, in one cell each where the sample has less than 16 of a length;
    a query's own id is no candidate (nor are other rows with this id); ties go to smaller ids; repeated rows count once;
    fewer than k candidates give fewer rows; an empty table gives none; other columns are not read.
    """
    v = F.transform(table[vector_col], lambda x: x.cast("double"))
    rows = table.select(table[id_col].cast("long").alias("id"), v.alias("vector")).where(F.col("id").isNotNull() & V.whole(F.col("vector")))
    rows = rows.where(F.exists("vector", lambda x: x != 0))
    data = staged(V.few_copies(rows, k), "vectors")
    asked = V.questions(rows, queries)
    drawn = data.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample_rows).toArrow()
    n, trees = data.count(), {}
    for dim in sorted(set(drawn["vector"].combine_chunks().value_lengths().to_pylist())) if drawn.num_rows else []:
        own = drawn.filter(pa.array([len(x) == dim for x in drawn["vector"].to_pylist()]))
        levels = math.ceil(math.log2(max(1, n * own.num_rows / drawn.num_rows / cell_rows)))
        points = _unit(V.matrix(own, np.float64)[1]) @ directions(dim, dims, seed)
        trees[dim] = KdTree(points, max(0, min(levels, int(math.log2(own.num_rows / 8)) if own.num_rows >= 16 else 0)))

    def placed(far: float | None):
        """Rows (id, vector[, kth]) with their cell, or (far) with all cells that a query has to go to."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for big in batches:
                for at in range(0, big.num_rows, 256):
                    b = pa.Table.from_batches([big.slice(at, 256)])
                    cells: list[list[int]] = [[0]] * b.num_rows
                    size = np.array(b["vector"].combine_chunks().value_lengths())
                    for dim in np.unique(size).tolist():
                        if dim in trees:
                            some = np.flatnonzero(size == dim)
                            points = _unit(V.matrix(b.take(pa.array(some)), np.float64)[1]) @ directions(dim, dims, seed)
                            if far is None:
                                found = trees[dim].cells(points)[:, None].tolist()
                            else:
                                kth = b["kth"].to_numpy()[some].astype(float)
                                limit = np.where(np.isnan(kth), np.inf, far * np.maximum(2 - 2 * kth, 1e-12))
                                found = [np.flatnonzero(near).tolist() for near in trees[dim].distances(points) < limit[:, None]]
                            for i, c in zip(some.tolist(), found, strict=True):
                                cells[i] = c
                    yield pa.RecordBatch.from_arrays([*(b[c].combine_chunks() for c in ("id", "vector")), pa.array(size, pa.int32()), pa.array(cells, pa.list_(pa.int32()))], ["id", "vector", "dim", "cells"])

        return run

    fields = "id long, vector array<double>, dim int, cells array<int>"
    at_home = staged(data.mapInArrow(placed(None), fields).select("id", "vector", "dim", F.col("cells")[0].alias("cell")), "cells")
    parts = staged(at_home.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts")), "parts")
    deal = lambda m, s: F.pmod(F.xxhash64("id", F.lit(s)), m).cast("int")
    blocks = at_home.join(parts, ["dim", "cell"]).withColumn("part", deal(F.col("parts"), 3)).drop("parts")
    block = ["dim", "cell", "part"]

    def find(one: pa.Table, other: pa.Table) -> pa.Table:
        if not one.num_rows or not other.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        qid, q = V.matrix(one, np.float64)
        ids, x = V.matrix(other, np.float64)
        best = V.Best(qid, k)
        verify(_unit(q), _unit(x), ids, best, dims, sure, seed)
        return best.table()

    def searched(visits: DataFrame) -> DataFrame:
        """k best of each visit (id, vector, dim, cell, part) in its block."""
        groups = visits.groupBy(*block).agg(F.ceil(F.count("*") / query_rows).cast("int").alias("groups"))
        left = visits.join(groups, block).withColumn("g", deal(F.col("groups"), 5))
        right = blocks.join(groups, block).withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        left = left.toDF(*(c + "1" for c in left.columns)).withColumnsRenamed({"id1": "id", "vector1": "vector"})
        return left.groupBy(*(c + "1" for c in [*block, "g"])).cogroup(right.groupBy(*block, "g")).applyInArrow(find, "query_id long, vec_id long, score double")

    home = asked.mapInArrow(placed(None), fields).select("id", "vector", "dim", F.col("cells")[0].alias("cell")).join(parts, ["dim", "cell"]).withColumn("part", deal(F.col("parts"), 7)).drop("parts")
    home = staged(home, "home")
    near = staged(searched(home), "near")
    kth = near.groupBy(F.col("query_id").alias("id")).agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") >= k).drop("n")
    away = asked.join(kth, "id", "left").mapInArrow(placed(reach_of(sure, dims)), fields).select("id", "vector", "dim", F.explode("cells").alias("cell"))
    away = away.join(parts, ["dim", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    away = staged(away.join(home.select("id", *block), ["id", *block], "left_anti"), "away")
    every = near.unionByName(searched(away)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows over their Euclidean lengths, without overflow or underflow."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
