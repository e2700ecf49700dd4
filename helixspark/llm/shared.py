"""What the operators share: tables kept in the shared folder, filters, and joins with values that many rows hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.sources.staging import Stage, new_path, remove, shared_dir, staged

__all__ = ["Stage", "fresh", "likely", "meet", "new_path", "release", "remove", "shared_dir", "staged"]

#: Bits of the filter in ``likely``; it is sent to executors (8 MB at most).
FILTER_BITS = 1 << 26


def fresh(columns: list[str]) -> str:
    """A prefix of underscores that no column's name starts with, for helper columns."""
    prefix = "_"
    while any(c.startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def likely(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is in ``wanted``, and few others, without a shuffle: a filter of FILTER_BITS bits is all that is sent to executors. Null keys go."""
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    bits = wanted.select(place.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("_bits"))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    known = rows.where(F.col(key).isNotNull()).join(F.broadcast(bits), F.bitmap_bucket_number(place) == F.col("_bucket"))
    return known.where(F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1).drop("_bucket", "_bits")


def release(spark: SparkSession) -> None:
    """Let the driver's JVM collect its garbage: Spark removes shuffle files once nothing refers to them, and else they stay until it happens to."""
    spark.sparkContext._jvm.System.gc()


def meet(rows: DataFrame, table: DataFrame, key: str, often: DataFrame, how: str = "left") -> DataFrame:
    """``rows`` joined with ``table``, which has one row at most for each value of ``key``.

    ``often`` has the values that so many rows hold that they'd fill a task, in a column of that name; there must be a bound to
    their number, as for values with more than a thousandth of all rows. Their rows of ``table`` are broadcast; only other rows
    are shuffled. Rows with a null key meet nothing.
    """
    few = F.broadcast(often.select(key))
    hot = rows.join(few, key, "left_semi").join(F.broadcast(table.join(few, key, "left_semi")), key, how)
    return hot.unionByName(rows.join(few, key, "left_anti").join(table.hint("merge"), key, how))
