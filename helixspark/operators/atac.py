"""Chromatin accessibility: cell checks, peak openness, gene scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixspark.functions.text import present, to_number
from helixspark.operators.order import quantiles

#: Default thresholds.
AT_LEAST = {"tss_enrichment": 4.0, "frip": 0.15, "n_fragments": 3000.0}
AT_MOST = {"blacklist_ratio": 0.05}


def check_cells(cells: DataFrame, at_least: dict | None = None, at_most: dict | None = None) -> DataFrame:
    """Sets qc_pass: all thresholds hold; columns that the table lacks are skipped, missing values fail."""
    rule = F.lit(True)
    for name, bound in (AT_LEAST if at_least is None else at_least).items():
        rule = rule & (to_number(F.col(name)) >= bound) if name in cells.columns else rule
    for name, bound in (AT_MOST if at_most is None else at_most).items():
        rule = rule & (to_number(F.col(name)) <= bound) if name in cells.columns else rule
    return cells.withColumn("qc_pass", F.coalesce(rule, F.lit(False)))


def require_passing(cells: DataFrame) -> DataFrame:
    if cells.where("qc_pass").isEmpty():
        raise ValueError("no cell passes the checks")
    return cells


def peak_openness(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """(peak_id, openness): counts of passing cells by peak, summed in each task first."""
    kept = counts.join(cells.where("qc_pass").select("cell_id"), "cell_id", "left_semi")
    return kept.groupBy("peak_id").agg(F.sum("value").alias("openness"))


def links(table: DataFrame, gene: str, distance: str, openness: str | None, position: str) -> DataFrame:
    """The peak-gene link table; a link is valid with a gene and a distance."""
    d = to_number(F.col(distance))
    out = table.select(F.col(position).alias("peak_id"), F.trim(F.col(gene).cast("string")).alias("gene_symbol"), d.alias("distance_to_tss"), (to_number(F.col(openness)) if openness else F.lit(None).cast("double")).alias("openness"), F.lit("nearest").alias("link_type"), F.col(position).alias("source_index"))
    return out.withColumn("is_valid_link", present(F.col("gene_symbol")).isNotNull() & F.col("distance_to_tss").isNotNull())


def supported(peaks: DataFrame, min_cells: int) -> DataFrame:
    return peaks.where(F.col("ncells").isNull() | (F.col("ncells") >= max(1, min_cells)))


def with_openness(link: DataFrame, openness: DataFrame) -> DataFrame:
    o = openness.select(F.col("peak_id").alias("_p"), F.col("openness").alias("_o"))
    return link.drop("openness").join(o, F.col("source_index") == F.col("_p"), "left").withColumn("openness", F.coalesce("_o", F.lit(0.0))).drop("_p", "_o")


def gene_scores(link: DataFrame, min_peaks: int = 1, use_abs: bool = True, digits: int = 6) -> DataFrame:
    """One row a gene: counts, distances, composite and openness-weighted scores, and rank.

    composite: mean (absolute) distance; weighted: by openness where its sum is above zero, else the plain mean; openness
    missing is 0. Ranked by composite, then more peaks, then gene; scores are compared at ``digits`` places.
    """
    d = F.col("distance_to_tss")
    x = F.abs(d) if use_abs else d
    w = F.coalesce("openness", F.lit(0.0))
    weighted = F.when(F.sum(w) > 0, F.sum(w * x) / F.sum(w)).otherwise(F.avg(x))
    genes = link.where("is_valid_link").groupBy(F.col("gene_symbol").alias("gene")).agg(F.count("*").alias("n_peaks"), F.avg(d).alias("mean_distance"), F.avg(F.abs(d)).alias("mean_abs_distance"), F.avg(x).alias("composite_score"), weighted.alias("weighted_composite_score"), F.sum(w).alias("openness_sum_qc"))
    medians = quantiles(link.where("is_valid_link").select(F.col("gene_symbol").alias("gene"), d.alias("d")), "d", {"median_distance": 0.5}, "gene")
    kept = genes.where(F.col("n_peaks") >= max(1, min_peaks)).join(medians, "gene", "left")
    # one row a gene: the global order is over a table of bounded size
    return kept.withColumn("rank", F.row_number().over(W.orderBy(F.round("composite_score", digits), F.col("n_peaks").desc(), "gene")).cast("long"))


def preview(scores: DataFrame, top_n: int = 50) -> DataFrame:
    """The first genes by rank, at least one."""
    return scores.where(F.col("rank") <= max(1, top_n))
