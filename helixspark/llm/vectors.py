"""What the two vector searches share: which vectors take part, blocks, and the merge of the blocks' results."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixspark.llm.textkit import list_parts

def whole(vector: Column) -> Column:
    """Not null, not empty, and without null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(F.exists(vector, bad), F.lit(True))


def matrix(table: pa.Table, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors (all of one length) of a table of (id, vector, ...)."""
    ids = table.column("id").to_numpy()
    offsets, values = list_parts(table.column("vector"))
    return ids, values.to_numpy(zero_copy_only=False).astype(dtype).reshape(len(ids), -1)


def few_copies(vectors: DataFrame, k: int) -> DataFrame:
    """Of equal vectors those with the k + 1 smallest ids: ties go to smaller ids, so no others can be in a result. The limit by rank also holds before the shuffle."""
    copies = W.partitionBy("vector").orderBy("id")
    return vectors.withColumn("_n", F.row_number().over(copies)).where(F.col("_n") <= k + 1).drop("_n")


def questions(vectors: DataFrame, queries: Column) -> DataFrame:
    """Rows that ask; of several vectors with one id, the smallest."""
    return vectors.where(queries).groupBy("id").agg(F.min("vector").alias("vector"))


def search(vectors: DataFrame, queries: Column, k: int, block_rows: int, query_rows: int, find: Callable[[pa.Table, pa.Table], pa.Table], score_type: str) -> DataFrame:
    """Top k of every query among all vectors of its length: (query_id, rank, vec_id, score).

    ``vectors`` has (id, vector). Data and queries are dealt into blocks of bounded size by hash, each pair of blocks is one task's work, and the blocks' k best are
    merged by rank. Queries are those rows that ``queries`` is true of; of several vectors with one id, the smallest asks and
    the best answers.
    """
    data, asked = few_copies(vectors, k), questions(vectors, queries)
    n, q = vectors.count(), asked.count()
    blocks, groups = max(1, -(-n // block_rows)), max(1, -(-q // query_rows))
    dim = F.size("vector").alias("dim")
    deal = lambda m, seed: F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = asked.select("id", "vector", dim, deal(groups, 3).alias("g"), every(blocks).alias("b"))
    right = data.select("id", "vector", dim, deal(blocks, 5).alias("b"), every(groups).alias("g"))

    kind = pa.int64() if score_type == "long" else pa.float64()

    def run(one: pa.Table, other: pa.Table) -> pa.Table:
        if not one.num_rows or not other.num_rows:
            return pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", kind)]).empty_table()
        return find(one, other)

    near = left.groupBy("dim", "g", "b").cogroup(right.groupBy("dim", "g", "b")).applyInArrow(run, f"query_id long, vec_id long, score {score_type}")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Best:
    """The k best (score, id) of each query so far: higher scores, then smaller ids. Scores are doubles or whole numbers."""

    def __init__(self, queries: np.ndarray, k: int, kind: type = np.float64):
        self.queries, self.k, self.kind = queries, k, kind
        self.none = -np.inf if kind is np.float64 else np.iinfo(np.int64).min
        self.score = np.full((len(queries), k), self.none, kind)
        self.id = np.full((len(queries), k), np.iinfo(np.int64).max)

    def worst(self) -> np.ndarray:
        """Each query's kth best score; minus infinity, or the least whole number, while there are fewer."""
        return self.score[:, -1]

    def _down(self, score: np.ndarray) -> np.ndarray:
        return np.argsort(-score if self.kind is np.float64 else ~score, axis=1, kind="stable")

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Candidates' scores for some queries (``none`` for no candidate); a query's own id and ids it has already are left out."""
        if not score.shape[1]:
            return
        ids = np.broadcast_to(ids, score.shape)
        score = np.where(ids == self.queries[rows][:, None], self.none, score)
        if score.shape[1] > 2 * self.k:
            # all above the kth best of these, and of those equal to it the smallest ids, by way of a partition
            part = np.argpartition(-score if self.kind is np.float64 else ~score, self.k, axis=1)
            edge = np.take_along_axis(score, part[:, self.k : self.k + 1], 1)
            if not (score == edge).sum(axis=1).max() > 1:
                score, ids = np.take_along_axis(score, part[:, : self.k + 1], 1), np.take_along_axis(ids, part[:, : self.k + 1], 1)
        s = np.concatenate((self.score[rows], score), axis=1)
        i = np.concatenate((self.id[rows], ids), axis=1)
        order = self._down(s)
        s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        order = np.argsort(i, axis=1, kind="stable")
        s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        s[:, 1:][i[:, 1:] == i[:, :-1]] = self.none
        order = self._down(s)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def table(self) -> pa.Table:
        some = self.score > self.none
        return pa.table({"query_id": np.repeat(self.queries, some.sum(axis=1)), "vec_id": self.id[some], "score": self.score[some]})
