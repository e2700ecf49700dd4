"""Prediction metrics over long-form (sample_id, gene_idx, y, f[, ctl]); a row is a sample, a column is a gene."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixspark.operators.order import running


def errors(df: DataFrame, by: str | None = None) -> DataFrame:
    """mse, rmse, mae over all values, or for each sample."""
    d = F.col("y") - F.col("f")
    aggs = [F.avg(d * d).alias("mse"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae")]
    return df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)


def r2(df: DataFrame) -> DataFrame:
    """Mean over genes of 1 - residual / total sum of squares; a constant gene is 1 if met exactly, else 0."""
    n, s, ss = F.count("*"), F.sum("y"), F.sum(F.col("y") * F.col("y"))
    per = df.groupBy("gene_idx").agg(F.sum((F.col("y") - F.col("f")) ** 2).alias("res"), (ss - s * s / n).alias("tot"))
    one = F.when(F.col("tot") > 1e-12, 1 - F.col("res") / F.col("tot")).when(F.col("res") == 0, 1.0).otherwise(0.0)
    return per.agg(F.avg(one).alias("r2"))


def _corr(x: str, y: str) -> Column:
    n, sx, sy = F.count("*"), F.sum(x), F.sum(y)
    cov = n * F.sum(F.col(x) * F.col(y)) - sx * sy
    vx, vy = n * F.sum(F.col(x) * F.col(x)) - sx * sx, n * F.sum(F.col(y) * F.col(y)) - sy * sy
    return F.when((vx > 1e-12) & (vy > 1e-12), cov / F.sqrt(F.greatest(vx, F.lit(0.0))) / F.sqrt(F.greatest(vy, F.lit(0.0))))


def _mean_or_null(name: str) -> Column:
    return F.when(F.count_if(F.col(name).isNull()) == 0, F.avg(name)).alias(name)


def pearson(df: DataFrame) -> DataFrame:
    """Mean over samples of the correlation over genes; NULL if a sample is constant."""
    return df.groupBy("sample_id").agg(_corr("y", "f").alias("pearson")).agg(_mean_or_null("pearson"))


def average_ranks(df: DataFrame, value: str, by: str, out: str) -> DataFrame:
    ties = W.partitionBy(by, value)
    return df.withColumn(out, (F.rank().over(W.partitionBy(by).orderBy(value)) + (F.count("*").over(ties) - 1) / 2).cast("double"))


def spearman(df: DataFrame) -> DataFrame:
    """Pearson of average ranks."""
    ranked = average_ranks(average_ranks(df, "y", "sample_id", "ry"), "f", "sample_id", "rf")
    return ranked.groupBy("sample_id").agg(_corr("ry", "rf").alias("spearman")).agg(_mean_or_null("spearman"))


def precision_at_k(df: DataFrame, k: int, n: int = 100) -> DataFrame:
    """Share of the k lowest (highest) predicted genes among the n lowest (highest) true ones, averaged over samples."""
    def place(value: str, up: bool) -> Column:
        return F.row_number().over(W.partitionBy("sample_id").orderBy(F.col(value) if up else F.col(value).desc(), F.col("gene_idx") if up else F.col("gene_idx").desc()))

    ranked = df.select("sample_id", place("y", True).alias("yl"), place("f", True).alias("fl"), place("y", False).alias("yh"), place("f", False).alias("fh"))
    hits = ranked.groupBy("sample_id").agg((F.count_if((F.col("yl") <= n) & (F.col("fl") <= k)) / k).alias("neg"), (F.count_if((F.col("yh") <= n) & (F.col("fh") <= k)) / k).alias("pos"))
    return hits.agg(F.avg("neg").alias("precision_neg"), F.avg("pos").alias("precision_pos"))


def _finite(df: DataFrame) -> DataFrame:
    """Rows with a number in y and f."""
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c) - F.col(c))  # noqa: E731  infinity less itself isn't one
    return df.where(number("y") & number("f"))


#: Terms of the kernel's series, and the width of a bin and the reach between bins' middles in units of the kernel's width.
TERMS, BIN, REACH = 20, 0.5, 12


def mmd(df: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Mean over genes of the squared maximum mean discrepancy with a Gaussian kernel, the diagonal included.

    Values are summed up in bins as moments about the bins' middles, for y less for f; the sum of the kernel over all pairs of two
    bins is a series in these moments, with the derivatives of the kernel at the distance of the middles. Only bins within
    ``REACH`` meet, and no pair of values is made: the work is linear in the values, and in the bins that have any.

    Error, for each pair of values: with |u| <= BIN the difference of what they stand off their middles, the first term that is left out
    is at most 1.09 (BIN sqrt(2))^TERMS / sqrt(TERMS!) < 7e-13 by the bound of Hermite functions, all after it less than a quarter of that;
    and values of bins that don't meet are REACH * BIN = 6 apart at least, where the kernel is below exp(-36) < 3e-16. Weights of all
    pairs add up to 4 n^2 at most, so the result is within 4e-12, but for rounding. Rows with a null or infinite y or f are left out.
    """
    scale = gamma**0.5
    usable = _finite(df).select("gene_idx", F.col("y").cast("double").alias("y"), F.col("f").cast("double").alias("f"))
    both = usable.select("gene_idx", (F.col("y") * scale).alias("v"), F.lit(1.0).alias("w")).unionByName(usable.select("gene_idx", (F.col("f") * scale).alias("v"), F.lit(-1.0).alias("w")))
    off = F.col("v") - (F.col("bin") + 0.5) * BIN
    bins = both.withColumn("bin", F.floor(F.col("v") / BIN).cast("long")).withColumn("s", off).groupBy("gene_idx", "bin").agg(*(F.sum(F.col("w") * F.pow("s", F.lit(j)) / float(math.factorial(j))).alias(f"m{j}") for j in range(TERMS)))
    bins = bins.select("gene_idx", "bin", F.array(*(f"m{j}" for j in range(TERMS))).alias("m"))
    signed = F.transform("m", lambda x, j: F.when(j % 2 == 0, x).otherwise(-x))
    near = bins.select("gene_idx", F.explode(F.sequence(F.col("bin"), F.col("bin") + REACH)).alias("bin"), F.col("bin").alias("bin0"), F.col("m").alias("a"))
    pairs = near.join(bins.select("gene_idx", "bin", signed.alias("b")), ["gene_idx", "bin"])
    apart = (F.col("bin0") - F.col("bin")) * BIN
    start = F.struct(F.lit(0.0).alias("h0"), F.exp(-apart * apart).alias("h"), F.lit(0.0).alias("sum"))

    def term(acc: Column, k: Column) -> Column:
        """One more term: the kernel's kth derivative, by its recurrence, times the moments whose orders add up to k."""
        moments = F.aggregate(F.sequence(F.lit(0), k), F.lit(0.0), lambda s, j: s + F.get("a", j) * F.get("b", k - j))
        further = -2 * (apart * acc["h"] + k * acc["h0"])
        return F.struct(acc["h"].alias("h0"), further.alias("h"), (acc["sum"] + acc["h"] * moments).alias("sum"))

    each = F.aggregate(F.sequence(F.lit(0), F.lit(TERMS - 1)), start, term)["sum"] * F.when(F.col("bin") == F.col("bin0"), 1.0).otherwise(2.0)
    sums = pairs.groupBy("gene_idx").agg(F.sum(each).alias("s"))
    n = usable.groupBy("gene_idx").agg(F.count("*").alias("n"))
    return n.join(sums, "gene_idx").agg(F.avg(F.col("s") / F.col("n") / F.col("n")).alias("mmd"))


def wasserstein(df: DataFrame) -> DataFrame:
    """Mean over genes of the mean absolute difference of sorted values.

    It is the area between both distribution functions: over a gene's distinct values in order, by how many y go before f there,
    times the step to the next value. Sums up to a value come from ranges, so a gene's samples are dealt over tasks, and equal values
    are one before they are ordered. Rows with a null, infinite or NaN y or f are left out.
    """
    usable = _finite(df)
    both = usable.select("gene_idx", F.col("y").cast("double").alias("v"), F.lit(1).alias("w")).unionByName(usable.select("gene_idx", F.col("f").cast("double").alias("v"), F.lit(-1).alias("w")))
    steps = running(both.groupBy("gene_idx", "v").agg(F.sum("w").alias("w")), "gene_idx", ["v"], "w", "v")
    area = steps.groupBy("gene_idx").agg(F.sum(F.abs("total") * F.coalesce(F.col("next") - F.col("v"), F.lit(0.0))).alias("area"))
    n = usable.groupBy("gene_idx").agg(F.count("*").alias("n"))
    return area.join(n, "gene_idx").agg(F.avg(F.col("area") / F.col("n")).alias("wasserstein"))


def bundle(df: DataFrame, k: int = 100, n: int = 100, deltas: bool = False, digits: int = 3) -> DataFrame:
    """All point metrics in one row, rounded half-even; ``deltas`` adds those of y - ctl and f - ctl with suffix _deg."""
    def row(d: DataFrame, suffix: str) -> DataFrame:
        parts = errors(d)
        for more in (r2(d), pearson(d), spearman(d), precision_at_k(d, k, n)):
            parts = parts.crossJoin(more)  # one row each
        return parts.select(*(F.bround(c, digits).alias(c + suffix) for c in parts.columns))

    out = row(df, "")
    if deltas:
        change = df.select("sample_id", "gene_idx", (F.col("y") - F.col("ctl")).alias("y"), (F.col("f") - F.col("ctl")).alias("f"))
        out = out.crossJoin(row(change, "_deg"))
    return out


def distribution_bundle(df: DataFrame, gamma: float = 1.0, digits: int = 3) -> DataFrame:
    both = mmd(df, gamma).crossJoin(wasserstein(df))  # one row each
    return both.select(F.bround("mmd", digits).alias("mmd"), F.bround("wasserstein", digits).alias("wasserstein"))
