"""Column resolution, standard columns, joins of metadata, and label encoding."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixspark.functions.celltypes import canonical
from helixspark.functions.text import present, safe, to_number

#: The standard metadata columns, in the order of a shard's text columns.
TEXT_COLUMNS = ["tissue", "region", "sampleType", "compartment", "cellType1", "cellType2", "majorCluster", "subCluster", "sex", "age", "perturbType", "perturbGene", "disease", "drug", "dose", "time"]
CELL_TYPE_COLUMNS = ["cellType1", "cellType2", "majorCluster", "subCluster"]
#: Names under which sources give metrics.
METRIC_CANDIDATES = {"n_genes": ["n_genes", "n_genes_by_counts", "nFeature_RNA"], "n_counts": ["n_counts", "total_counts", "nCount_RNA"], "pct_mt": ["pct_mt", "pct_counts_mt", "percent.mt", "percent_mito"]}
ATAC_RENAMES = {"TSSEnrichment": "tss_enrichment", "FRIP": "frip", "nFrags": "n_fragments", "BlacklistRatio": "blacklist_ratio"}


def resolve(columns: Sequence[str], wanted: str) -> str | None:
    """The column meant by a name: the same, else the same but for case, else but for case and separators; later columns win."""
    if wanted in columns:
        return wanted
    for key in (str.lower, lambda s: re.sub(r"[_\-\s]", "", s).lower()):
        named = {key(c): c for c in columns}
        if key(wanted) in named:
            return named[key(wanted)]
    return None


def guess(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    named = {c.lower(): c for c in columns}
    return next((named[c.lower()] for c in candidates if c.lower() in named), None)


def standardize(df: DataFrame, column_map: Mapping[str, str], fill: str = "") -> DataFrame:
    """Adds the standard columns: mapped ones as strings (cell types in canonical form), the rest ``fill``. Others stay."""
    new: dict[str, Column] = {}
    for target, source in column_map.items():
        found = resolve(df.columns, source)
        if found:
            text = F.col(f"`{found}`").cast("string")
            new[target] = canonical(text) if target in CELL_TYPE_COLUMNS else text
    for name in TEXT_COLUMNS:
        if name not in new and name not in df.columns:
            new[name] = F.lit(fill)
    return df.withColumns(new)


def with_literals(df: DataFrame, literals: Mapping[str, str], column_map: Mapping[str, str] = {}, fill: str = "") -> DataFrame:
    """``standardize``, with literals where neither the map nor the table has values of its own."""
    new = {c: F.lit(v) for c, v in literals.items() if c not in column_map and c not in df.columns}
    return standardize(df.withColumns(new) if new else df, column_map, fill)


def qc_flag(df: DataFrame, column: str | None, value: object) -> DataFrame:
    """qc_pass: the column's text equals the value; true without a column, false for NULL."""
    found = resolve(df.columns, column) if column else None
    return df.withColumn("qc_pass", F.coalesce(F.col(f"`{found}`").cast("string") == str(value), F.lit(False)) if found else F.lit(True))


def detect_metrics(df: DataFrame) -> DataFrame:
    """n_genes, n_counts and pct_mt from the first column that is known to hold them; NULL without one; kept where present."""
    new = {}
    for target, names in METRIC_CANDIDATES.items():
        if target not in df.columns:
            found = guess(df.columns, names)
            new[target] = to_number(F.col(f"`{found}`")) if found else F.lit(None).cast("double")
    return df.withColumns(new) if new else df


def rename_atac(df: DataFrame) -> DataFrame:
    have = {old: new for old, new in ATAC_RENAMES.items() if old in df.columns}
    kept = [F.col(f"`{c}`") for c in df.columns if c not in have]  # names that differ in case alone are the same to Spark
    return df.select(*kept, *(to_number(F.col(old)).alias(new) for old, new in have.items()))


def text_columns(df: DataFrame, columns: Sequence[str] = TEXT_COLUMNS, fill: str = "none") -> Column:
    """The text columns of a row as an array; columns that the table lacks are ``fill``."""
    return F.array(*(safe(F.col(c).cast("string"), fill) if c in df.columns else F.lit(fill) for c in columns))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in a stated order; NULL keys are one key."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def enrich(left: DataFrame, right: DataFrame, key: str | None = None, order: Sequence[Column | str] = (), right_key: str | None = None) -> DataFrame:
    """Left join with only the right side's new columns, its keys made unique first; NULL keys match nothing.

    Without a key, the first shared column is it; tables without a shared column are an error.
    """
    key = key or next((c for c in left.columns if c in right.columns), None)
    if key is None:
        raise ValueError("the tables share no column")
    theirs = right_key or key
    new = [c for c in right.columns if c not in left.columns and c != theirs]
    once = first_by(right.where(F.col(theirs).isNotNull()), [theirs], list(order) or new or [theirs])
    return left.join(once.select(F.col(theirs).alias("_key"), *new), F.col(key) == F.col("_key"), "left").drop("_key")


def lookup(left: DataFrame, right: DataFrame, key: str, value: str, out: str, default: str = "none") -> DataFrame:
    """One looked-up value with a default."""
    once = right.groupBy(F.col(key).alias("_key")).agg(F.max(value).alias("_value"))
    return left.join(once, F.col(key) == F.col("_key"), "left").withColumn(out, F.coalesce("_value", F.lit(default))).drop("_key", "_value")


def fallback(first: Column, second: Column, default: str = "none") -> Column:
    return F.coalesce(present(first), present(second), F.lit(default))


def encode_sorted(df: DataFrame, column: str, out: str) -> DataFrame:
    """Ids from 0 in the labels' order; 0 for NULL. Only the distinct labels are ranked in one place."""
    labels = df.select(F.col(column).alias("_label")).where("_label is not null").distinct()
    ids = labels.withColumn("_id", (F.row_number().over(W.orderBy("_label")) - 1).cast("long"))
    return df.join(ids, F.col(column) == F.col("_label"), "left").withColumn(out, F.coalesce("_id", F.lit(0)).cast("long")).drop("_label", "_id")


def encode_first(df: DataFrame, column: str, position: str, out: str) -> DataFrame:
    """Ids from 0 in the order in which labels appear first by ``position``."""
    labels = df.groupBy(F.col(column).alias("_label")).agg(F.min(position).alias("_at"))
    ids = labels.withColumn("_id", (F.row_number().over(W.orderBy("_at", "_label")) - 1).cast("long")).drop("_at")
    return df.join(ids, F.col(column).eqNullSafe(F.col("_label")), "left").withColumn(out, F.col("_id")).drop("_label", "_id")


def number_rows(df: DataFrame, order: str, cell: Column, out: str) -> DataFrame:
    """Row numbers from 0 in the order of a column without one global window.

    ``cell`` is a non-decreasing function of the order column; rows are numbered in each cell, and running counts of
    cells, a small table, give each cell's first number.
    """
    counts = df.groupBy(cell.alias("_cell")).agg(F.count("*").alias("_rows"))
    before = counts.withColumn("_first", F.coalesce(F.sum("_rows").over(W.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_rows")
    own = df.withColumn("_cell", cell).withColumn("_n", F.row_number().over(W.partitionBy("_cell").orderBy(order)) - 1)
    return own.join(before, "_cell").withColumn(out, (F.col("_first") + F.col("_n")).cast("long")).drop("_cell", "_first", "_n")
