"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixspark.llm.shared import Stage


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id that a link (a, b) touches; component is the smallest id reachable.

    Each round hangs a node's neighbours on the smallest of them; minima are aggregated before the shuffle and joined
    back, so hubs can be split. Links live in the shared folder between rounds; only a count and a checksum reach the
    driver. Ids must not be null. Ends when a round changes nothing, which equal checksums suggest and an anti-join of
    the links proves; there is no other limit of rounds.
    """
    edges = Stage(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct(), "links")
    mark = None
    while mark is None or mark[0]:
        both = edges.df.unionByName(edges.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(down, "v")
        small = joined.select(F.col("m").alias("u"), F.col("u").alias("v")).where("u < v").unionByName(down.select(F.col("m").alias("u"), "v")).distinct()
        new, old = Stage(small, "links"), edges
        edges = new
        now = tuple(edges.df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        ended = now == mark and edges.df.join(old.df, ["u", "v"], "left_anti").isEmpty()
        old.drop()
        if ended:
            break
        mark = now
    low = edges.df.groupBy("v").agg(F.min("u").alias("component")).withColumnRenamed("v", "id")
    roots = edges.df.select(F.col("u").alias("id")).distinct().join(low, "id", "left_anti").select("id", F.col("id").alias("component"))
    return low.unionByName(roots)
