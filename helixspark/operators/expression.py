"""Expression matrices in long form: quality metrics, filters, variable genes, normalisation, samples, tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixspark.functions.sequences import padded, rank_bin
from helixspark.functions.text import shuffle_key, to_number
from helixspark.operators.columns import number_rows
from helixspark.operators.order import quantiles
from helixspark.sources.staging import staged


def to_long(df: DataFrame, cell: str, values: str, genes: str | None = None) -> DataFrame:
    """(cell_id, gene_idx, value) from array columns: a dense row by position, or a ragged pair cut to the shorter list."""
    if genes is None:
        return df.select(F.col(cell).alias("cell_id"), F.posexplode(values).alias("gene_idx", "value"))
    n = F.least(F.size(genes), F.size(values))
    both = F.arrays_zip(F.slice(genes, F.lit(1), n).alias("g"), F.slice(values, F.lit(1), n).alias("v"))
    return df.where(n > 0).select(F.col(cell).alias("cell_id"), F.explode(both).alias("z")).select("cell_id", F.col("z.g").alias("gene_idx"), F.col("z.v").alias("value"))


def summed(expr: DataFrame) -> DataFrame:
    """One row for each cell and gene."""
    return expr.groupBy("cell_id", "gene_idx").agg(F.sum("value").alias("value"))


def cell_metrics(expr: DataFrame, cells: DataFrame, mito: DataFrame, count_zeros: bool = False) -> DataFrame:
    """n_genes, n_counts and pct_mt of every cell; empty cells have zeros.

    ``mito`` holds the gene_idx of mitochondrial genes. ``count_zeros`` counts every stored value (ragged inputs), else
    those above zero.
    """
    marked = expr.join(mito.select("gene_idx", F.lit(1).alias("_mt")).distinct(), "gene_idx", "left")
    n = F.count("*") if count_zeros else F.count_if(F.col("value") > 0)
    sums = marked.groupBy("cell_id").agg(n.alias("n_genes"), F.sum("value").alias("n_counts"), F.sum(F.when(F.col("_mt") == 1, F.col("value"))).alias("_mt"))
    share = F.when(F.col("n_counts") > 0, 100 * F.coalesce("_mt", F.lit(0.0)) / F.col("n_counts")).otherwise(F.lit(0.0))
    out = cells.join(sums, "cell_id", "left").withColumn("pct_mt", share)
    return out.withColumns({"n_genes": F.coalesce("n_genes", F.lit(0)), "n_counts": F.coalesce("n_counts", F.lit(0.0))}).drop("_mt")


def mito_genes(genes: DataFrame, prefix: str = "MT-", column: str = "gene_symbol") -> DataFrame:
    """The genes whose name starts with the prefix of mitochondrial ones."""
    return genes.where(F.col(column).startswith(prefix))


def medians(cells: DataFrame, names: Sequence[str] = ("n_genes", "n_counts", "pct_mt")) -> DataFrame:
    """One row with the exact median of each column over all cells; null where a column has no values."""
    each = staged(cells.select(*(F.col(c).cast("double").alias(c) for c in names)), "metrics")
    long = each.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in names))).alias("x")).select("x.*")
    found = quantiles(long, "v", {"median": 0.5}, "name")
    return found.agg(*(F.max(F.when(F.col("name") == c, F.col("median"))).alias(c) for c in names))


def drop_doublets(cells: DataFrame, flag: str = "predicted_doublet") -> DataFrame:
    return cells.where(~F.coalesce(F.col(flag).cast("boolean"), F.lit(False))) if flag in cells.columns else cells


def cell_passes(min_genes: float = 0, max_genes: float = 0, min_counts: float = 0, max_counts: float = 0, max_pct_mt: float = 0, strict_mt: bool = False) -> Column:
    """Bounds on n_genes, n_counts and pct_mt; a bound of 0 is off; missing counts are 0, a missing share is 100."""
    genes, counts = (F.coalesce(to_number(F.col(c)), F.lit(0.0)) for c in ("n_genes", "n_counts"))
    mt = F.coalesce(to_number(F.col("pct_mt")), F.lit(100.0))
    rules = [(min_genes, genes >= min_genes), (max_genes, genes <= max_genes), (min_counts, counts >= min_counts), (max_counts, counts <= max_counts), (max_pct_mt, mt < max_pct_mt if strict_mt else mt <= max_pct_mt)]
    keep = F.lit(True)
    for bound, rule in rules:
        keep = keep & rule if bound > 0 else keep
    return keep


def filter_cells(cells: DataFrame, **bounds: float) -> DataFrame:
    flag = F.coalesce(F.col("qc_pass"), F.lit(False)) if "qc_pass" in cells.columns else F.lit(True)
    return cells.where(flag & cell_passes(**bounds))


def keep_cells(expr: DataFrame, cells: DataFrame) -> DataFrame:
    return expr.join(cells.select("cell_id"), "cell_id", "left_semi")


def gene_variance(expr: DataFrame, n_cells: int) -> DataFrame:
    """Variance of each gene over n_cells cells, absent values being zeros: max(E[x^2] - E[x]^2, 0)."""
    mean, square = F.sum("value") / n_cells, F.sum(F.col("value") * F.col("value")) / n_cells
    return expr.groupBy("gene_idx").agg(F.greatest(square - mean * mean, F.lit(0.0)).alias("variance"))


def top_variable(variance: DataFrame, n: int, digits: int = 9) -> DataFrame:
    """is_hvg for the n genes of highest variance, ties to the larger index; all genes, with variance 0, for n <= 0."""
    if n <= 0:
        return variance.withColumns({"variance": F.lit(0.0), "is_hvg": F.lit(True)})
    top = variance.orderBy(F.round("variance", digits).desc(), F.col("gene_idx").desc()).limit(n).select("gene_idx", F.lit(True).alias("is_hvg"))
    return variance.join(top, "gene_idx", "left").withColumn("is_hvg", F.coalesce("is_hvg", F.lit(False)))


def normalized(expr: DataFrame, target: float = 1e4) -> DataFrame:
    """log1p of values scaled to a fixed total for each cell."""
    total = F.sum("value").over(W.partitionBy("cell_id"))
    return expr.withColumn("value", F.log1p(F.col("value") * target / total))


def uniform_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(shuffle_key(F.col(id_col), seed), id_col).limit(n)


def stratified_sample(df: DataFrame, id_col: str, key: str, total: int, seed: int = 42) -> DataFrame:
    """Equal numbers from each group (missing is one), at least one, without replacement, and at most ``total`` in all."""
    if key not in df.columns:
        raise ValueError(f"no column {key}")
    grouped = df.withColumn("_group", F.coalesce(F.col(key).cast("string"), F.lit("NA")))
    groups = grouped.select("_group").distinct().count()
    per = max(1, total // max(1, groups))
    order = shuffle_key(F.col(id_col), seed)
    ranked = grouped.withColumn("_n", F.row_number().over(W.partitionBy("_group").orderBy(order, id_col))).where(F.col("_n") <= per)
    return ranked.orderBy(order, id_col).limit(total).drop("_group", "_n")


def top_genes(expr: DataFrame, k: int, n_bins: int, use_abs: bool = False, over: int | None = None, tokens: DataFrame | None = None) -> DataFrame:
    """The k strongest genes of each cell with rank and bin: (cell_id, gene_idx, [token,] rank, bin).

    Zeros and genes without a token go first; ties go to the smaller gene. With ``over``, genes are ranked first, zeros
    included, the k + over strongest kept, and only then those without a token dropped. ``tokens``: (gene_idx, token).
    """
    score = F.abs("value") if use_abs else F.col("value")
    strongest = W.partitionBy("cell_id").orderBy(score.desc(), "gene_idx")
    names = ["gene_idx"] + (["token"] if tokens is not None else [])
    known = lambda d: d if tokens is None else d.join(tokens.where("token > 0").select("gene_idx", "token"), "gene_idx")
    if over is not None:
        expr = known(expr.withColumn("_n", F.row_number().over(strongest)).where(F.col("_n") <= k + over).drop("_n"))
    else:
        expr = known(expr.where("value <> 0"))
    ranked = expr.withColumn("rank", F.row_number().over(strongest)).where(F.col("rank") <= k)
    length = F.count("*").over(W.partitionBy("cell_id"))
    return ranked.withColumn("bin", rank_bin(F.col("rank"), length, n_bins)).select("cell_id", *names, F.col("rank").cast("long").alias("rank"), "bin")


def token_rows(top: DataFrame, k: int, token: str = "gene_idx", cells: DataFrame | None = None) -> DataFrame:
    """One row a cell: gene_ids and bin_ids padded to k, and length. With ``cells``, empty cells stay as padding."""
    pairs = F.array_sort(F.collect_list(F.struct("rank", F.col(token).cast("int").alias("t"), F.col("bin").cast("short").alias("b"))))
    rows = top.groupBy("cell_id").agg(pairs.alias("_p"))
    if cells is not None:
        rows = cells.select("cell_id").join(rows, "cell_id", "left")
    size = F.coalesce(F.size("_p"), F.lit(0))
    rows = rows.withColumn("_p", F.when(F.col("_p").isNull(), F.array().cast(rows.schema["_p"].dataType)).otherwise(F.col("_p")))
    return rows.select("cell_id", padded(F.transform("_p", lambda x: x["t"]), k).alias("gene_ids"), padded(F.transform("_p", lambda x: x["b"].cast("int")), k).alias("bin_ids"), F.greatest(size, F.lit(0)).cast("short").alias("lengths"))


def top_genes_in_row(df: DataFrame, genes: str, values: str, k: int, use_abs: bool = False) -> Column:
    """For input that is already nested: the k strongest (gene, value) of a row, without a shuffle."""
    n = F.least(F.size(genes), F.size(values))
    score = lambda v: F.abs(v) if use_abs else v
    both = F.transform(F.arrays_zip(F.slice(genes, F.lit(1), n).alias("g"), F.slice(values, F.lit(1), n).alias("v")), lambda z: F.struct((-score(z["v"])).alias("s"), z["g"].alias("g"), z["v"].alias("v")))
    return F.slice(F.array_sort(F.filter(both, lambda z: z["s"] != 0)), 1, k)


def top_genes_dense(rows: DataFrame, cell: str, values: str, tokens: DataFrame, k: int, n_bins: int, over: int = 128, use_abs: bool = False) -> DataFrame:
    """(cell, gene_ids, bin_ids, lengths) of dense rows, each an array by position: the k + over strongest, of these the first k with a token.

    Works inside the chunk of rows that a task has read, so no value is exploded or shuffled. Zeros count; null and NaN values are
    zeros; ties go to the smaller position. ``tokens`` (gene_idx, token) is a row a position and so as small as one row of the
    matrix; positions that it lacks have no token.
    """
    import numpy as np
    import pyarrow as pa

    known = {int(r[0]): int(r[1]) for r in tokens.where("token > 0").select("gene_idx", "token").collect()}
    width = max(known, default=-1) + 1
    lookup = np.zeros(width, np.int64)
    lookup[list(known)] = list(known.values())

    def one(score: np.ndarray) -> np.ndarray:
        """Positions of the strongest, in order."""
        n = min(len(score), k + over)
        if n < len(score):
            edge = np.partition(score, len(score) - n)[len(score) - n]
            at = np.flatnonzero(score >= edge)
        else:
            at = np.arange(len(score))
        return at[np.argsort(-score[at], kind="stable")][:n]

    def run(batches):
        for b in batches:
            genes, bins, lengths = [], [], []
            for row in b.column(1):
                v = np.zeros(0) if not row.is_valid else np.nan_to_num(row.values.to_numpy(zero_copy_only=False).astype(np.float64), nan=0.0)
                at = one(np.abs(v) if use_abs else v)
                token = np.where(at < width, lookup[np.minimum(at, width - 1)], 0) if width else np.zeros(len(at), np.int64)
                token = token[token > 0][:k]
                n = len(token)
                genes.append(np.pad(token, (0, k - n)))
                bins.append(np.pad(n_bins - (np.arange(n) * n_bins) // max(1, n), (0, k - n)))
                lengths.append(n)
            lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(np.concatenate(x) if x else np.zeros(0, int), kind))
            yield pa.RecordBatch.from_arrays([b.column(0), lists(genes, pa.int32()), lists(bins, pa.int32()), pa.array(lengths, pa.int16())], names=[cell, "gene_ids", "bin_ids", "lengths"])

    kind = rows.schema[cell].dataType.simpleString()
    return rows.select(cell, values).mapInArrow(run, f"`{cell}` {kind}, gene_ids array<int>, bin_ids array<int>, lengths short")


def with_shards(rows: DataFrame, shard_size: int, cell: Column) -> DataFrame:
    """shard_id of fixed-size shards in the order of cell_id."""
    return number_rows(rows, "cell_id", cell, "_row").withColumn("shard_id", F.floor(F.col("_row") / shard_size).cast("long")).drop("_row")


def seurat_variable(expr: DataFrame, cells: DataFrame, batch: str, n_top: int, span: float = 0.3) -> DataFrame:
    """Variable genes by standardised variance: (gene_idx, n_batches, median_rank, score, is_hvg).

    In each batch, a degree-2 local regression of log variance on log mean gives each gene's expected spread; values are
    standardised by it and clipped at the root of the number of cells, and their variance ranks the genes. Genes are
    ordered by the median rank over batches in which they rank in the top, then by the number of such batches. Sums are
    Spark aggregates; only one row a gene and batch reaches the regression.
    """
    import pandas as pd

    from helixspark.operators.loess import expected_spread

    batches = cells.select("cell_id", F.col(batch).alias("batch"))
    sizes = batches.groupBy("batch").agg(F.count("*").alias("n"))
    joined = expr.join(batches, "cell_id")
    stats = joined.groupBy("batch", "gene_idx").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss")).join(sizes, "batch").where("n > 1")
    stats = stats.withColumn("mean", F.col("s") / F.col("n")).withColumn("var", F.greatest((F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1), F.lit(0.0)))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(spread=expected_spread(pdf["mean"].to_numpy(), pdf["var"].to_numpy(), span))[["batch", "gene_idx", "mean", "n", "spread"]]

    kinds = dict(stats.dtypes)
    fitted = stats.select("batch", "gene_idx", "mean", "var", "n").groupBy("batch").applyInPandas(fit, f"batch {kinds['batch']}, gene_idx {kinds['gene_idx']}, mean double, n long, spread double")
    top = F.sqrt("n")
    z = F.least((F.col("value") - F.col("mean")) / F.col("spread"), top)
    zero = -F.col("mean") / F.col("spread")
    sums = joined.join(fitted, ["batch", "gene_idx"]).where("spread > 0").groupBy("batch", "gene_idx").agg(F.sum(z).alias("z"), F.sum(z * z).alias("zz"), F.count("*").alias("k"), F.first("n").alias("n"), F.first(zero).alias("z0"))
    rest = F.col("n") - F.col("k")
    s, ss = F.col("z") + rest * F.col("z0"), F.col("zz") + rest * F.col("z0") * F.col("z0")
    scored = sums.select("batch", "gene_idx", ((ss - s * s / F.col("n")) / (F.col("n") - 1)).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("batch").orderBy(F.col("score").desc(), "gene_idx")))
    best = F.when(F.col("rank") <= n_top, F.col("rank"))
    genes = ranked.groupBy("gene_idx").agg(F.count(best).alias("n_batches"), F.median(best).alias("median_rank"), F.avg("score").alias("score"))
    top_genes_ = genes.orderBy(F.col("median_rank").asc_nulls_last(), F.col("n_batches").desc(), "gene_idx").limit(n_top).select("gene_idx", F.lit(True).alias("is_hvg"))
    return genes.join(top_genes_, "gene_idx", "left").withColumn("is_hvg", F.coalesce("is_hvg", F.lit(False)))
