"""From a data set's files to cell_meta, gene_meta and data_source, and to its expression values: one entry a format.

An annotated matrix is a folder with obs and var tables and the matrix X as CSR triples; a signature set is a dense matrix with
four tab-separated tables; an Arrow set is a folder of subsets, each with splits, as data set libraries save them.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.operators import columns, expression
from helixspark.operators.columns import METRIC_CANDIDATES
from helixspark.sources import files, ranges, sinks, tables
from helixspark.sources.tables import Source

#: Columns that name cells, signatures and genes, the likeliest first.
CELL_COLUMNS = ["sample_id", "_index", "index", "__index_level_0__", "cell_id", "barcode"]
SIGNATURE_COLUMNS = ["sig_id", "inst_id"]
SET_CELL_COLUMNS = ["BARCODE_SUB_LIB_ID", "barcode", "cell_id"]
ENSEMBL_COLUMNS = ["ensembl_id", "gene_ids", "Ensembl"]
#: What signatures and sets of single perturbations don't say.
SIGNATURE_LITERALS = dict.fromkeys(["region", "sampleType", "compartment", "cellType1", "cellType2", "majorCluster", "subCluster"], "none")
SET_LITERALS = dict.fromkeys(["region", "sampleType", "compartment", "cellType2", "majorCluster", "subCluster", "sex", "age", "disease", "time"], "none") | {"perturbType": "drug"}


@dataclass
class Read:
    """What an entry has written: the folder of the intermediates, and both tables read back."""

    path: str
    cells: DataFrame
    genes: DataFrame
    source: Source


def _first(names: Sequence[str], candidates: Sequence[str]) -> str | None:
    return next((c for c in candidates if c in names), None)


def _write(spark: SparkSession, out: str, version: str, cells: DataFrame, genes: DataFrame, source: Source) -> Read:
    path = sinks.intermediates(out, version, cells, genes, source)
    return Read(path, spark.read.parquet(f"{path}/cell_meta.parquet"), spark.read.parquet(f"{path}/gene_meta.parquet"), source)


def _standard(df: DataFrame, column_map: Mapping[str, str], qc_col: str | None, qc_val: object, literals: Mapping[str, str], metrics: bool = True, more: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Checks, metrics, mapped columns and literals of a metadata table."""
    df = columns.qc_flag(df, qc_col if qc_col in df.columns else None, qc_val)
    if metrics:
        for target, names in (more or {}).items():
            found = _first(df.columns, names)
            if target not in df.columns and found and not _first(df.columns, METRIC_CANDIDATES[target]):
                df = df.withColumn(target, F.col(f"`{found}`").try_cast("double"))
        df = columns.detect_metrics(df)
    else:
        df = df.withColumns({c: F.lit(None).cast("double") for c in METRIC_CANDIDATES})
    return columns.with_literals(df, literals, dict(column_map))


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of an annotated matrix in file order: name.parquet, name.csv or name.tsv."""
    for suffix in ("parquet", "csv", "tsv"):
        path = f"{folder}/{name}.{suffix}"
        if tables.exists(spark, path):
            return tables.read_table(spark, path)
    raise FileNotFoundError(f"{folder} has no table {name}")


def inspect_h5ad(spark: SparkSession, folder: str) -> dict:
    """Shape, columns, first genes and first cell; the matrix's header is read, none of its values."""
    obs, var = _table(spark, folder, "obs"), _table(spark, folder, "var")
    data = ranges.stored(posixpath.join(folder, "X", "data.npy"))
    out = tables.inspect_expression(spark.createDataFrame([], "gene_idx long"), obs, var)
    return out | {"n_stored": data.shape[0], "value_type": str(data.dtype)}


def read_h5ad(spark: SparkSession, folder: str, out: str, version: str, column_map: Mapping[str, str] = {}, qc_col: str | None = None, qc_val: object = "", id_col: str | None = None, literals: Mapping[str, str] = {}) -> Read:
    """An annotated matrix's intermediates. cell_meta has sample_id and row, the cell's place in X; gene_meta has col, the gene's."""
    obs, var = (tables.in_file_order(_table(spark, folder, name), at) for name, at in (("obs", "row"), ("var", "col")))
    name = id_col or _first(obs.columns, CELL_COLUMNS) or obs.columns[0]
    cells = _standard(obs.withColumn("sample_id", F.col(f"`{name}`").cast("string")), column_map, qc_col, qc_val, literals)
    gene = _first(var.columns, ["_index", "index", "__index_level_0__", "gene"]) or var.columns[0]
    named = F.col(f"`{gene}`").cast("string")
    found = _first(var.columns, ENSEMBL_COLUMNS)
    ensembl = F.coalesce(F.col(f"`{found}`").cast("string"), F.lit("")) if found else F.lit("")
    genes = tables.gene_meta(var.select(named.alias("_id"), ensembl.alias("_ensembl"), "col"), "_id", "_id", "_ensembl", keep=["col"])
    return _write(spark, out, version, cells, genes, Source("h5ad", folder))


def h5ad_expression(spark: SparkSession, read: Read, rows: tuple[int, int] | None = None, values: int = ranges.VALUES) -> DataFrame:
    """(cell_id, gene_idx, value) of an annotated matrix, or of its rows low to high, in tasks of about ``values`` stored values."""
    entries = ranges.read_csr(spark, posixpath.join(read.source.path, "X"), rows, values)
    return entries.join(read.cells.select("row", F.col("sample_id").alias("cell_id")), "row").select("cell_id", F.col("col").alias("gene_idx"), "value")


def _shared(left: DataFrame, right: DataFrame) -> str | None:
    return next((c for c in left.columns[1:] if c in right.columns), None)


def inspect_gctx(spark: SparkSession, matrix: str, geneinfo: str | None = None, siginfo: str | None = None, first: int = 10) -> dict:
    """Shape and type of a signature set's matrix from its header, and columns and first ids of its tables."""
    array = ranges.stored(matrix)
    out: dict = {"shape": list(array.shape), "value_type": str(array.dtype)}
    for name, path in (("genes", geneinfo), ("signatures", siginfo)):
        if path:
            table = tables.read_delimited(spark, path, "\t")
            out[name] = {"columns": table.columns, "first": [r[0] for r in table.select(table.columns[0]).limit(first).collect()]}
    return out


def read_gctx(spark: SparkSession, matrix: str, siginfo: str, cellinfo: str, compoundinfo: str, geneinfo: str, out: str, version: str, column_map: Mapping[str, str] = {}, sig_id_col: str | None = None, qc_col: str | None = None, qc_val: object = "", cell_key: str | None = None, compound_key: str | None = None, literals: Mapping[str, str] = {}) -> Read:
    """A signature set's intermediates: signatures with the first cell line and compound of their keys, genes with their place in a row of the matrix.

    cell_meta has row, a signature's place in siginfo. Metrics aren't known. A key that the tables don't share leaves them unjoined.
    """
    sig = tables.in_file_order(tables.read_delimited(spark, siginfo, "\t"), "row")
    own = [c for c in sig.columns if c != "row"]
    for path, key in ((cellinfo, cell_key), (compoundinfo, compound_key)):
        other = tables.in_file_order(tables.read_delimited(spark, path, "\t"), "_order")
        key = key or _shared(sig.select(*own), other)
        if key in own and key in other.columns:
            sig = columns.enrich(sig, other, key, ["_order"]).drop("_order")
    name = sig_id_col or _first(sig.columns, SIGNATURE_COLUMNS) or own[0]
    cells = _standard(sig.withColumn("sample_id", F.col(f"`{name}`")), column_map, qc_col, qc_val, literals, metrics=False)
    info = tables.in_file_order(tables.read_delimited(spark, geneinfo, "\t"), "_index")
    names = [c for c in info.columns if c != "_index"]
    genes = tables.gene_meta(info, _first(names, ["gene_id", "entrez_id"]) or names[0], _first(names, ["gene_symbol", "symbol"]), _first(names, ["ensembl_id", "Ensembl_Gene_ID"]), "_index")
    shape = ranges.stored(matrix).shape
    return _write(spark, out, version, cells, genes, Source("gctx", matrix, {"shape": list(shape)}))


def gctx_rows(spark: SparkSession, read: Read, rows: tuple[int, int] | None = None, chunk_bytes: int = ranges.BYTES) -> DataFrame:
    """(cell_id, values) of a signature set, in tasks of about ``chunk_bytes``; a row stays one array."""
    dense = ranges.read_dense(spark, read.source.path, rows, bytes_of_task=chunk_bytes)
    return dense.join(read.cells.select("row", F.col("sample_id").alias("cell_id")), "row").select("cell_id", "values")


def gctx_tokens(spark: SparkSession, read: Read, tokens: DataFrame, k: int = 1024, n_bins: int = 32, over: int = 128, use_abs: bool = True, rows: tuple[int, int] | None = None) -> DataFrame:
    """Token arrays of a signature set: each chunk of rows is cut to its strongest genes where it is read; only these meet the cells' names. ``tokens``: (gene_idx, token)."""
    dense = ranges.read_dense(spark, read.source.path, rows)
    top = expression.top_genes_dense(dense, "row", "values", tokens, k, n_bins, over, use_abs)
    return top.join(read.cells.select("row", F.col("sample_id").alias("cell_id")), "row").select("cell_id", "gene_ids", "bin_ids", "lengths")


def splits(spark: SparkSession, folder: str) -> list[str]:
    """The splits that a set names, in its order; none if it is a single one."""
    if not tables.exists(spark, f"{folder}/dataset_dict.json"):
        return []
    return list(json.loads(spark.read.option("wholetext", True).text(f"{folder}/dataset_dict.json").first()[0])["splits"])


def split_folder(spark: SparkSession, folder: str, split: str | None = "train") -> str:
    """The folder of the preferred split, else of the first, else of the set itself."""
    names = splits(spark, folder)
    return f"{folder}/{split if split in names else names[0]}" if names else folder


def read_set(spark: SparkSession, folder: str, split: str | None = "train", wanted: Sequence[str] | None = None, task_bytes: int = files.TASK_BYTES) -> DataFrame:
    """Rows of a split of an Arrow set, of the wanted columns only; a split's files are those that it names, if it does."""
    return files.read_arrow(spark, split_folder(spark, folder, split), wanted, task_bytes=task_bytes)


def inspect_set(spark: SparkSession, root: str, subset: str = "obs_metadata", sample: int = 10) -> dict:
    """Splits, rows, columns and a sample (the first columns of a row) of a subset; rows are counted by batches' headers where these say them."""
    folder = f"{root}/{subset}"
    at = split_folder(spark, folder, None)
    index = files.arrow_index(files.files_of(spark, at))
    rows, unknown = index.agg(F.sum("rows"), F.count_if(F.col("rows").isNull())).first()
    df = files.read_arrow(spark, at)
    first = df.select(*(F.col(f"`{c}`") for c in df.columns[:sample])).limit(1).collect()
    return {"subset": subset, "splits": splits(spark, folder) or ["(single)"], "num_rows": df.count() if unknown else rows or 0, "column_names": df.columns, "sample": {c: str(v) for r in first for c, v in r.asDict().items()}}


def read_hf_dataset(spark: SparkSession, root: str, out: str, version: str, column_map: Mapping[str, str] = {}, qc_col: str | None = None, qc_val: object = "", split: str = "train", obs: str = "obs_metadata", gene: str = "gene_metadata", cell_line: str | None = "cell_line_metadata", cell_line_key: str | None = None, id_col: str | None = None, literals: Mapping[str, str] = {}) -> Read:
    """An Arrow set's intermediates. Cell lines are joined if the set has them and a column is shared; other faults are raised."""
    cells = read_set(spark, f"{root}/{obs}", split)
    if cell_line and tables.exists(spark, f"{root}/{cell_line}"):
        lines = read_set(spark, f"{root}/{cell_line}", split)
        key = cell_line_key or next((c for c in cells.columns if c in lines.columns), None)
        cells = columns.enrich(cells, lines, key) if key else cells
    name = id_col or _first(cells.columns, SET_CELL_COLUMNS) or cells.columns[0]
    more = {"n_genes": ["num_genes"], "n_counts": ["num_counts"]}
    done = _standard(cells.withColumn("sample_id", F.col(f"`{name}`").cast("string")), column_map, qc_col, qc_val, literals, more=more)
    found = read_set(spark, f"{root}/{gene}", split)
    token = _first(found.columns, ["token_id", "gene_id"]) or found.columns[0]
    genes = tables.gene_meta(found, token, _first(found.columns, ["gene_symbol"]), _first(found.columns, ["ensembl_id"]), None, token)
    return _write(spark, out, version, done, genes, Source("hf", root, {"subset_split": split}))


def set_expression(spark: SparkSession, root: str, subset: str = "expression_data", split: str = "train", cell: str = "BARCODE_SUB_LIB_ID", genes: str = "genes", values: str = "expressions", task_bytes: int = files.TASK_BYTES) -> DataFrame:
    """(cell_id, genes, values) of an Arrow set, which must have these three columns; no other is read."""
    rows = read_set(spark, f"{root}/{subset}", split, [cell, genes, values], task_bytes)
    return rows.select(F.col(cell).cast("string").alias("cell_id"), F.col(genes).alias("genes"), F.col(values).alias("values"))


def read_vectors(spark: SparkSession, sources: Sequence[tuple[str, str]], dtype: str = "float32", width: int = 256) -> tuple[DataFrame, str]:
    """(id, vec) of the first source that fits, and its path. A source is a file of ids and rows, and an array of fixed-length vectors.

    A source whose files aren't there, or whose array has another number of rows than there are ids, is passed over; the
    number comes from the array's header or length. ``dtype`` and ``width`` hold for arrays without a header.
    """
    for ids, path in sources:
        if not (tables.exists(spark, ids) and tables.exists(spark, path)):
            continue
        index, array = tables.read_entity_index(spark, ids), ranges.stored(path, dtype, width)
        if index.count() != array.shape[0]:
            continue
        return index.join(ranges.read_dense(spark, path, None, dtype, width), "row").select("id", F.col("values").alias("vec")), path
    raise FileNotFoundError("none fits of " + ", ".join(path for _, path in sources))


def gene_debug_table(info: DataFrame, mapped: DataFrame, key: str = "entrez_id", index: Column | str = "gctx_index") -> DataFrame:
    """(gctx_gene_index, entrez_id, ensembl_norm, gene_symbol, hgnc_num, hgnctoken) of every gene of a matrix: how it was mapped, 0 where it wasn't. Of several rows with one key in ``mapped`` all are kept."""
    genes = info.select(F.col(index).alias("gctx_gene_index") if isinstance(index, str) else index.alias("gctx_gene_index"), F.col(key).cast("string").alias("entrez_id"))
    told = mapped.select(F.col(key).cast("string").alias("_key"), "ensembl_norm", "gene_symbol", "hgnc_num", F.col("hgnc_token").alias("hgnctoken"))
    return genes.join(told, F.col("entrez_id") == F.col("_key"), "left").drop("_key").withColumn("hgnctoken", F.coalesce("hgnctoken", F.lit(0)))
