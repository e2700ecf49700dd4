"""Exact top-k inner products of integer vectors by dual-tree search over cover trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixspark.llm import vectors as V
from helixspark.llm.shared import staged
from helixspark.llm.textkit import list_parts

#: Greedy centres of a node's cover; points that none of them reaches go to their nearest.
CENTRES = 64
#: Scores that 64 bits can't hold are shown as the nearest that they can.
TOP = (1 << 63) - 1
#: Pairs of a query and a cell whose bounds are held at once, and components of vectors in a batch of rows that are sent.
BOUNDS, SENT = 1 << 18, 1 << 19


class CoverTree:
    """Nested covers: a node's points lie within its radius of its centre; greedy centres of its children are further apart
    than the radius over ``base``, and points beyond their reach, or in children of few points, go to the nearest centre."""

    def __init__(self, points: np.ndarray, leaf: int, base: float = 1.6):
        self.points, self.squares = points, (points**2).sum(axis=1)
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.rows: list[np.ndarray] = []
        self.children: list[np.ndarray] = []
        self._node(np.arange(len(points)), 0)
        stack = [0]
        while stack:
            node = stack.pop()
            rows = self.rows[node]
            if len(rows) <= leaf or self.radius[node] == 0:
                continue
            centres, owner = self._cover(rows, self.centre[node], self.radius[node] / base)
            sizes = np.bincount(owner, minlength=len(centres))
            large = np.flatnonzero(sizes * 4 >= leaf)
            if len(large) < 2:
                large = np.arange(max(2, min(len(centres), -(-len(rows) // leaf))))
            keep = centres[large]
            away = ~np.isin(owner, large)
            to = np.full(len(centres), -1)
            to[large] = np.arange(len(large))
            owner = to[owner]
            owner[away] = self._distances(rows[away], keep).argmin(axis=1)
            self.children[node] = np.array([self._node(rows[owner == c], keep[c]) for c in range(len(keep))])
            stack += self.children[node].tolist()
        self.radius, self.centre = np.array(self.radius), np.array(self.centre)
        self.leaves = np.array([i for i, c in enumerate(self.children) if not len(c)])

    def _distances(self, rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return self.squares[rows][:, None] - 2 * self.points[rows] @ self.points[centres].T + self.squares[centres]

    def _node(self, rows: np.ndarray, centre: int) -> int:
        self.centre.append(centre)
        self.radius.append(float(np.sqrt(((self.points[rows] - self.points[centre]) ** 2).sum(axis=1).max())))
        self.rows.append(rows)
        self.children.append(np.zeros(0, np.int64))
        return len(self.rows) - 1

    def _cover(self, rows: np.ndarray, first: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Greedy centres, the parent's own first, and whose each row is: the first centre's within reach, else the nearest's."""
        centres, owner, left, centre = [], np.full(len(rows), -1), np.arange(len(rows)), first
        while len(left) and len(centres) < CENTRES:
            far = self.squares[rows[left]] - 2 * (self.points[rows[left]] @ self.points[centre]) + self.squares[centre]
            far[rows[left] == centre] = 0
            inside = far <= reach * reach
            owner[left[inside]] = len(centres)
            centres.append(centre)
            left, far = left[~inside], far[~inside]
            centre = rows[left[far.argmax()]] if len(left) else -1
        centres = np.array(centres)
        if len(left):
            owner[left] = self._distances(rows[left], centres).argmin(axis=1)
        return centres, owner


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly: by doubles where they are exact, else by 64-bit words, which are exact
    unless a product leaves 64 bits; what may leave them is computed as long numbers."""
    if max(np.abs(q.astype(np.float64)).max(initial=0), 1) * max(np.abs(x.astype(np.float64)).max(initial=0), 1) * q.shape[1] < 2.0**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    near = np.abs(q.astype(np.float64)) @ np.abs(x.astype(np.float64)).T
    with np.errstate(over="ignore"):
        out = (q[:, None, :] * x[None, :, :]).sum(axis=2)
    for i, j in np.argwhere(near >= 2.0**62).tolist():
        out[i, j] = max(-TOP, min(TOP, sum(a * b for a, b in zip(q[i].tolist(), x[j].tolist(), strict=True))))
    return out


def dual_search(q: np.ndarray, x: np.ndarray, ids: np.ndarray, best: V.Best, leaf: int = 48, query_leaf: int = 4) -> float:
    """Fill ``best`` for all queries; returns the share of products that were computed.

    Both sides have a cover tree. A leaf of queries first meets the data leaf whose centre promises most. Then a data node
    meets the query nodes that are left of its parent's: a pair goes when centres' product and both radii prove that no product
    reaches the worst kth score of the query node's group; query nodes wider than the data node give way to their children.
    """
    fq, fx = q.astype(np.float64), x.astype(np.float64)
    qt, xt = CoverTree(fq, query_leaf), CoverTree(fx, leaf)
    qn, xn = np.sqrt((fq[qt.centre] ** 2).sum(axis=1)), np.sqrt((fx[xt.centre] ** 2).sum(axis=1))
    product = fq[qt.centre] @ fx[xt.centre].T
    reach = (qn + qt.radius)[:, None] * (xn + xt.radius)[None, :]
    bound = product + qt.radius[:, None] * xn[None, :] + xt.radius[None, :] * qn[:, None] + qt.radius[:, None] * xt.radius[None, :]
    bound += 1e-9 * reach + 1e-6
    limit = np.full(len(qt.rows), -np.inf)
    parent = np.full(len(qt.rows), -1)
    for node, kids in enumerate(qt.children):
        parent[kids] = node
    below = np.array([not len(c) for c in qt.children])
    done = np.zeros((len(qt.rows), len(xt.rows)), bool)
    computed = 0

    def meet(groups: np.ndarray, node: int) -> None:
        nonlocal computed
        groups = groups[~done[groups, node]]
        if not len(groups):
            return
        done[groups, node] = True
        rows, data = np.concatenate([qt.rows[g] for g in groups]), xt.rows[node]
        for a in range(0, len(rows), 256):
            best.add(rows[a : a + 256], products(q[rows[a : a + 256]], x[data]), ids[data])
        computed += len(rows) * len(data)
        worst = best.worst().astype(np.float64)
        limit[groups] = np.minimum.reduceat(worst[rows], np.concatenate(([0], np.cumsum([len(qt.rows[g]) for g in groups])[:-1])))
        for up in np.unique(parent[groups])[::-1].tolist():
            while up >= 0 and (new := limit[qt.children[up]].min()) > limit[up]:
                limit[up], up = new, parent[up]

    first = xt.leaves[product[np.ix_(qt.leaves, xt.leaves)].argmax(axis=1)]
    for node in np.unique(first).tolist():
        meet(qt.leaves[first == node], node)
    stack = [(0, np.zeros(1, np.int64))]
    while stack:
        node, groups = stack.pop()
        while True:
            groups = groups[bound[groups, node] >= limit[groups]]
            wide = ~below[groups] & ((qt.radius[groups] >= xt.radius[node]) | (not len(xt.children[node])))
            if not wide.any():
                break
            groups = np.concatenate([groups[~wide], *(qt.children[g] for g in groups[wide])])
        if not len(groups):
            continue
        if len(xt.children[node]):
            kids = xt.children[node]
            stack += [(c, groups) for c in kids[np.argsort(bound[np.ix_(groups, kids)].max(axis=0))].tolist()]
        else:
            meet(groups, node)
    return computed / max(1, len(q) * len(x))


class Cells:
    """Centres of blocks, by length of vectors: the leaves of a cover tree over drawn rows. What lies in a block and how far is found by all rows."""

    def __init__(self, drawn: pa.Table, cells: int):
        self.centres: dict[int, np.ndarray] = {}
        vectors = drawn.column("vector").to_pylist()
        for dim in sorted({len(v) for v in vectors}):
            own = np.array([v for v in vectors if len(v) == dim], np.float64)
            tree = CoverTree(own, max(1, len(own) // cells))
            self.centres[dim] = own[tree.centre[tree.leaves]]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centre of each row, and a bound of the distance to it; rows of a length that wasn't drawn are in cell -1."""
        c = self.centres.get(x.shape[1])
        if c is None:
            return np.full(len(x), -1), np.full(len(x), np.inf)
        cell = np.concatenate([((c * c).sum(axis=1) - 2 * x[a : a + 1024] @ c.T).argmin(axis=1) for a in range(0, len(x), 1024)])
        return cell, np.sqrt(((x - c[cell]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-9

    def bounds(self, q: np.ndarray, cells: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """No product of a query (row) with a vector of a cell (column) is above this."""
        c = self.centres.get(q.shape[1])
        if c is None:
            return np.full((len(q), len(cells)), np.inf)
        c, size = c[cells], np.sqrt((q * q).sum(axis=1))
        return q @ c.T + (size[:, None] * radius) * (1 + 1e-9) + 1e-6 + 1e-9 * size[:, None] * np.sqrt((c * c).sum(axis=1))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) of a batch's rows of each length."""
    offsets, values = list_parts(batch.column("vector"))
    n, flat = np.diff(offsets), values.to_numpy(zero_copy_only=False).astype(np.float64)
    for dim in np.unique(n).tolist():
        at = np.flatnonzero(n == dim)
        yield at, flat[offsets[at][:, None] + np.arange(dim)]


def top_products(table: DataFrame, queries: Column, k: int = 5, block_rows: int = 16384, query_rows: int = 2048, id_col: str = "vec_id", vector_col: str = "vector", drawn: int = 16384, told: dict | None = None) -> DataFrame:
    """Each query's k highest inner products, exactly: (query_id, rank, vec_id, score) over vectors of whole numbers.

    A table beyond ``block_rows`` is cut into blocks about the leaves of a cover tree of ``drawn`` rows, a block's radius being that of
    all its rows. A query first meets the block whose centre promises most, and then, with its kth score from there, only those
    blocks whose centre and radius don't rule it out; rows of other blocks aren't sent. In each pair of blocks, a cover tree of the
    queries and one of the data are searched together. Rows are sent in batches of bounded size, however many blocks a query meets;
    where nothing is ruled out, their number grows with queries times blocks. ``told`` gets share, the part of all pairs of a query and a row that were sent.

    Products are whole numbers; those that 64 bits can't hold are shown as the nearest that they can. Vectors that are null or empty or hold
    null or non-finite components take no part, nor do null ids; lengths are searched apart; a query's own id is no
    candidate (nor are other rows with this id); ties go to smaller ids; repeated rows count once; fewer than k candidates
    give fewer rows; an empty table gives none; other columns are not read.
    """
    rows = table.select(table[id_col].cast("long").alias("id"), table[vector_col].alias("vector")).where(F.col("id").isNotNull() & V.whole(F.col("vector")))

    def find(asked: pa.Table, data: pa.Table) -> pa.Table:
        qid, q = V.matrix(asked, np.int64)
        ids, x = V.matrix(data, np.int64)
        best = V.Best(qid, k, np.int64)
        dual_search(q, x, ids, best)
        return best.table()

    n = rows.count()
    if n <= block_rows:
        return V.search(rows, queries, k, block_rows, query_rows, find, "long")
    data, asked = V.few_copies(rows, k), V.questions(rows, queries)
    cells = Cells(data.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(drawn).select("vector").toArrow(), -(-4 * n // block_rows))
    kind = rows.schema["vector"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in _by_length(b):
                cell, far = cells.place(x)
                some = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.full(len(at), x.shape[1], np.int32)), pa.array(cell.astype(np.int32)), pa.array(far)], ["id", "vector", "dim", "cell", "far"])

    placed = staged(data.mapInArrow(place, f"id long, vector {kind}, dim int, cell int, far double"), "placed")
    blocks: dict[int, list[tuple[int, int, float]]] = {}
    for r in placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect():  # as many as centres, at most
        blocks.setdefault(r["dim"], []).append((r["cell"], r["n"], r["radius"]))

    def to_blocks(first: bool):
        """Rows for each query and block: the block that promises most; or all others that its kth score doesn't rule out."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for every, vectors in _by_length(b):
                    dim = vectors.shape[1]
                    known = sorted(blocks.get(dim, []))
                    if not known:
                        continue
                    cell, radius = np.array([c for c, _, _ in known]), np.array([r for *_, r in known])
                    for s in range(0, len(every), step := max(1, BOUNDS // len(known))):
                        at, q = every[s : s + step], vectors[s : s + step]
                        home = cells.bounds(q, cell, np.zeros(len(cell))).argmax(axis=1)
                        if first:
                            i, j = np.arange(len(q)), home
                        else:
                            bound = cells.bounds(q, cell, radius)
                            kth = b.column("kth").take(pa.array(at))
                            limit = np.where(kth.is_null().to_numpy(zero_copy_only=False), -np.inf, pc.fill_null(kth, 0).to_numpy().astype(np.float64))
                            want = bound * (1 + 1e-12 * np.sign(bound)) >= limit[:, None]
                            want[np.arange(len(q)), home] = False
                            i, j = np.nonzero(want)
                        for t in range(0, len(i), most := max(1, SENT // dim)):
                            some = b.select(["id", "vector"]).take(pa.array(at[i[t : t + most]]))
                            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.full(some.num_rows, dim, np.int32)), pa.array(cell[j[t : t + most]].astype(np.int32))], ["id", "vector", "dim", "cell"])

        return run

    def meet(sent: DataFrame) -> DataFrame:
        """Scores of queries in the blocks that they are sent to; blocks are dealt in parts of ``block_rows``, queries in groups of ``query_rows``."""
        asked_of = {(r["dim"], r["cell"]): r["n"] for r in sent.groupBy("dim", "cell").agg(F.count("*").alias("n")).collect()}
        size = {(d, c): m for d, own in blocks.items() for c, m, _ in own}
        if told is not None:
            told["pairs"] = told.get("pairs", 0) + sum(m * size[key] for key, m in asked_of.items())
        plan = [(*key, -(-size[key] // block_rows), -(-m // query_rows)) for key, m in asked_of.items()]
        parts = F.broadcast(sent.sparkSession.createDataFrame(plan, "dim int, cell int, parts int, groups int"))
        deal = lambda seed, most: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(most)).cast("int")
        every = lambda most: F.explode(F.sequence(F.lit(0), F.col(most) - 1))
        left = sent.join(parts, ["dim", "cell"]).select("id", "vector", "dim", "cell", deal(3, "groups").alias("g"), every("parts").alias("b"))
        right = placed.join(parts, ["dim", "cell"]).select("id", "vector", "dim", "cell", deal(5, "parts").alias("b"), every("groups").alias("g"))

        def run(one: pa.Table, other: pa.Table) -> pa.Table:
            if not one.num_rows or not other.num_rows:
                return pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]).empty_table()
            return find(one, other)

        return staged(left.groupBy("dim", "cell", "g", "b").cogroup(right.groupBy("dim", "cell", "g", "b")).applyInArrow(run, "query_id long, vec_id long, score long"), "products")

    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    asked = staged(asked, "asked")
    sent_kind = f"id long, vector {kind}, dim int, cell int"
    near = meet(staged(asked.mapInArrow(to_blocks(True), sent_kind), "sent"))
    kth = near.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    more = staged(asked.join(kth, "id", "left").mapInArrow(to_blocks(False), sent_kind), "sent")
    # rows of one id can lie in several blocks: the best of them answers
    found = near.unionByName(meet(more)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    if told is not None:
        told["share"] = told.pop("pairs") / max(1, asked.count() * placed.count())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
