"""Order statistics of groups of any size: exact quantiles by counting, and running sums in an order, without a group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixspark.sources.staging import staged

#: Cells that a range of values is counted in, and values of a range that are sorted instead.
CELLS, FEW = 4096, 4096
#: Groups whose ranges are broadcast; more meet their rows by a shuffle.
GROUPS = 100_000


def _cell(v: Column, low: Column, high: Column) -> Column:
    """The cell of a value in its range, never decreasing with it; the least and the greatest value are in the first and the last one."""
    width = high / 2 - low / 2
    part = F.when(width > 0, (v / 2 - low / 2) / width).otherwise(F.when(v > low, 1.0).otherwise(0.0))
    return F.floor(F.least(part, F.lit(1.0)) * (CELLS - 1)).cast("int")


def quantiles(df: DataFrame, value: str, shares: Mapping[str, float], by: str | None = None) -> DataFrame:
    """Exact quantiles, linear between neighbours: one row a group with a column for each named share, such as {"median": 0.5}.

    Groups of at most ``FEW`` values are sorted. In larger ones values below a rank are counted in cells of the group's range, and the
    cell that holds the rank becomes the next range, until a range has one value or few enough to sort. So a task holds counts, or
    ``FEW`` values, of a group, and rows of large groups are only filtered, never dealt by group. Null values and groups are left out; NaN stands
    above all others; groups without values have no row.
    """
    group = F.col(by) if by else F.lit(0)
    rows = df.select(group.alias("g"), F.col(value).cast("double").alias("v")).where("v is not null and g is not null")
    hot = rows.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > FEW).select("g")
    if hot.isEmpty():
        out = _sorted(rows, shares)
    else:
        hot = staged(hot, "large-groups")
        known = F.broadcast(hot) if hot.count() <= GROUPS else hot
        same = F.col("g").eqNullSafe(F.col("_g"))
        known = known.withColumnRenamed("g", "_g")
        out = _sorted(rows.join(known, same, "left_anti"), shares).unionByName(_counted(rows.join(known, same, "left_semi"), shares))
    return out.withColumnRenamed("g", by) if by else out.drop("g")


def _between(low: Column, high: Column, part: Column) -> Column:
    return F.when((low == high) | (part == 0), low).otherwise(low * (1 - part) + high * part)


def _sorted(rows: DataFrame, shares: Mapping[str, float]) -> DataFrame:
    """Quantiles of groups that are small enough to sort."""
    values = rows.groupBy("g").agg(F.sort_array(F.collect_list("v")).alias("a"))
    at = {name: F.lit(float(q)) * (F.size("a") - 1) for name, q in shares.items()}
    return values.select("g", *(_between(F.get("a", F.floor(x).cast("int")), F.get("a", F.ceil(x).cast("int")), x - F.floor(x)).alias(name) for name, x in at.items()))


def _counted(rows: DataFrame, shares: Mapping[str, float]) -> DataFrame:
    """Quantiles of groups of any size."""
    usual = ~F.isnan("v") & (F.abs("v") != F.lit(float("inf")))
    # outside the range of usual values there are only three others
    place = F.when(F.isnan("v"), 3).when(F.col("v") == float("inf"), 2).when(F.col("v") == float("-inf"), 0).otherwise(1)
    kinds = rows.groupBy("g").agg(F.count("*").alias("n"), *(F.count_if(place == k).alias(f"n{k}") for k in (0, 1)), F.min(F.when(usual, F.col("v"))).alias("low"), F.max(F.when(usual, F.col("v"))).alias("high"), F.count_if(place == 2).alias("n2"))
    at = lambda q: F.lit(float(q)) * (F.col("n") - 1)
    ranks = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), (F.floor(at(q)) if side == 0 else F.ceil(at(q))).alias("k"), (at(q) - F.floor(at(q))).alias("part")) for name, q in shares.items() for side in (0, 1)))
    asked = staged(kinds.select("*", F.explode(ranks).alias("r")).select("g", "n0", "n1", "n2", "low", "high", "r.*"), "ranks")
    odd = F.when(F.col("k") < F.col("n0"), float("-inf")).when(F.col("k") >= F.col("n0") + F.col("n1") + F.col("n2"), float("nan")).when(F.col("k") >= F.col("n0") + F.col("n1"), float("inf"))
    done = asked.where(odd.isNotNull()).select("g", "name", "side", "part", odd.alias("v"))
    left = asked.where(odd.isNull()).select("g", "name", "side", "part", (F.col("k") - F.col("n0")).alias("k"), "low", "high", F.col("n1").alias("n"))
    while True:
        done = done.unionByName(left.where("low = high").select("g", "name", "side", "part", F.col("low").alias("v")))
        small, large = (left.where("low < high").where(f"n {c} {FEW}") for c in ("<=", ">"))
        held = _inside(rows.where(usual), small).groupBy("g", "low", "high").agg(F.sort_array(F.collect_list("v")).alias("a"))
        done = done.unionByName(small.join(held, ["g", "low", "high"]).select("g", "name", "side", "part", F.get("a", F.col("k").cast("int")).alias("v")))
        if large.isEmpty():
            break
        counts = _inside(rows.where(usual), large).groupBy("g", "low", "high", _cell(F.col("v"), F.col("low"), F.col("high")).alias("cell")).agg(F.count("*").alias("n"), F.min("v").alias("low2"), F.max("v").alias("high2"))
        below = counts.withColumn("below", F.sum("n").over(W.partitionBy("g", "low", "high").orderBy("cell")) - F.col("n"))
        left = staged(large.drop("n").join(below, ["g", "low", "high"]).where("k >= below and k < below + n").select("g", "name", "side", "part", (F.col("k") - F.col("below")).alias("k"), F.col("low2").alias("low"), F.col("high2").alias("high"), "n"), "ranks")
    value_of = lambda name, side: F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col("v")))
    part_of = lambda name: F.max(F.when(F.col("name") == name, F.col("part")))
    return done.groupBy("g").agg(*(_between(value_of(name, 0), value_of(name, 1), part_of(name)).alias(name) for name in shares))


def _inside(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows within their group's ranges (low, high): equal ranges once, broadcast if there are at most GROUPS of them."""
    once = ranges.select("g", "low", "high").distinct()
    few = once.limit(GROUPS + 1).count() <= GROUPS
    return rows.join(F.broadcast(once) if few else once, "g").where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))


def running(df: DataFrame, by: str, order: Sequence[str], amount: str | Sequence[str], follows: str | None = None) -> DataFrame:
    """Adds ``total``, the sum of ``amount`` over a group's rows up to this one, and ``next``, the following row's ``follows``.

    Of several amounts the sums are named total_ and the amount. Rows are dealt by range of (by, order); sums and first rows of each
    (range, group), one row for each range that a group meets, give what comes before and after. A group can span all tasks.
    (by, order) must tell rows apart.
    """
    sums = {amount: "total"} if isinstance(amount, str) else {a: f"total_{a}" for a in amount}
    dealt = staged(df.repartitionByRange(by, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    inside = W.partitionBy("_part", by).orderBy(*order)
    after = F.col(follows) if follows else F.lit(None).cast("double")
    own = dealt.withColumns({f"_sum_{a}": F.sum(a).over(inside) for a in sums} | {"_next": F.lead(after).over(inside)})
    parts = dealt.groupBy("_part", by).agg(*(F.sum(a).alias(f"_all_{a}") for a in sums), F.min_by(after, F.struct(*order)).alias("_first"))
    across = W.partitionBy(by).orderBy("_part")
    earlier = across.rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("_part", by, *(F.coalesce(F.sum(f"_all_{a}").over(earlier), F.lit(0)).alias(f"_before_{a}") for a in sums), F.lead("_first").over(across).alias("_then"))
    out = own.join(parts, ["_part", by]).withColumns({total: F.col(f"_sum_{a}") + F.col(f"_before_{a}") for a, total in sums.items()} | {"next": F.coalesce("_next", "_then")})
    return out.select(*df.columns, *sums.values(), "next")
