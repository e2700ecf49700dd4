"""Readers and inspectors. HDF5, NPZ and tensor files enter as Parquet in long or array form; everything else is read as it is."""

from __future__ import annotations

import json
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixspark.functions.text import after_colon
from helixspark.operators.atac import links
from helixspark.operators.columns import guess

#: Relations of the small graph.
EDGE_TYPES = ["drug_targets", "gene_encodes_protein", "gene_in_pathway", "has_go_bp", "has_go_cc", "has_go_mf", "in_complex_with", "ligand_receptor", "protein_interacts", "tf_regulates"]
#: The folders of a chromatin bundle.
BUNDLE_FOLDERS = ["peak_bc", "gene_scores", "ChromVar", "LSI_embedding", "markerpeak_target"]

#: Names of columns in accessibility tables, the likeliest first.
GENE_COLUMNS = ["nearestGene", "gene", "gene_symbol", "gene_name", "symbol", "geneName"]
DISTANCE_COLUMNS = ["distToTSS", "distance", "distance_to_tss", "dist", "distToGeneStart"]
OPENNESS_COLUMNS = ["ncounts", "openness", "score", "count", "counts", "signal", "weight"]


@dataclass
class Source:
    """Where a data set lies and in which format; never a path that data pass through."""

    format: str
    path: str
    extra: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self))


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, header: bool = True) -> DataFrame:
    """All columns as strings; the delimiter is the one most frequent in the first line if none is given."""
    if sep is None:
        first = spark.read.text(path).limit(1).collect()
        line = first[0][0] if first else ""
        sep = max(["\t", ",", ";", "|"], key=line.count)
    return spark.read.option("sep", sep).option("header", header).csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: Parquet, JSON lines, comma or tab separated; else the delimiter is guessed."""
    low = path.lower().removesuffix(".gz")
    if low.endswith((".parquet", "/")):
        return spark.read.parquet(path)
    if low.endswith((".json", ".jsonl")):
        return spark.read.json(path)
    return read_delimited(spark, path, {"csv": ",", "tsv": "\t"}.get(low.rpartition(".")[2]))


def inspect(df: DataFrame, rows: int = 5, columns: int | None = None) -> dict:
    """Columns, types, number of rows and the first rows."""
    names = df.columns[:columns]
    return {"columns": df.columns, "types": dict(df.dtypes), "n_rows": df.count(), "head": [r.asDict() for r in df.select(*(F.col(f"`{c}`") for c in names)).limit(rows).collect()]}


def inspect_expression(expr: DataFrame, cells: DataFrame, genes: DataFrame) -> dict:
    """Shape, columns, first genes and first cell of an expression data set."""
    return {"shape": (cells.count(), genes.count()), "obs_columns": cells.columns, "var_columns": genes.columns, "first_genes": [r[0] for r in genes.select(genes.columns[0]).limit(20).collect()], "first_cell": next((r.asDict() for r in cells.limit(1).collect()), {}), "is_sparse": "gene_idx" in expr.columns}


def inspect_atac(df: DataFrame, rows: int = 5) -> dict:
    return inspect(df, rows) | {"gene_column": guess(df.columns, GENE_COLUMNS), "distance_column": guess(df.columns, DISTANCE_COLUMNS), "openness_column": guess(df.columns, OPENNESS_COLUMNS)}


def matrix_header(spark: SparkSession, path: str) -> tuple[int, int, int | None]:
    """(rows, columns, non-zeros or None) of a MatrixMarket file, gzipped or not."""
    first = spark.read.text(path).where("not startswith(value, '%')").limit(1).collect()
    parts = first[0][0].split() if first else []
    if len(parts) not in (2, 3):
        raise ValueError(f"no MatrixMarket size in {path}")
    return int(parts[0]), int(parts[1]), int(parts[2]) if len(parts) == 3 else None


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value) of a MatrixMarket coordinate file, counted from 0; the size line is left out by its place in the file."""
    text = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = text.where("not startswith(line, '%') and trim(line) <> ''")
    first = lines.agg(F.min("block")).first()[0]
    # the size line is the first one of its block; only that block's lines are put in order, within the scan that gives them
    own = lines.where(F.col("block") == first).withColumn("n", F.row_number().over(W.partitionBy("block").orderBy("at")))
    size = own.where("n = 1").select("line").first()
    if size is None or len(size["line"].split()) != 3:
        raise ValueError(f"no size of a coordinate matrix in {path}")
    part = lambda i: F.get(F.split(F.trim("line"), r"\s+"), F.lit(i))
    entries = lines.where(F.col("block") != first).select("line").unionByName(own.where("n > 1").select("line"))
    return entries.select((part(0).cast("long") - 1).alias("row"), (part(1).cast("long") - 1).alias("col"), part(2).cast("double").alias("value"))


def in_file_order(scan: DataFrame, out: str = "pos") -> DataFrame:
    """Adds row numbers from 0 in the order of files and of places in them, to a DataFrame as the reader gave it.

    Rows are numbered in each block of a file, as large as a split at most; counts of blocks, a small table, give each block's first number.
    """
    own = scan.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    blocks = own.groupBy("_file", "_block").agg(F.count("*").alias("_rows"))
    first = blocks.withColumn("_first", F.sum("_rows").over(W.orderBy("_file", "_block")) - F.col("_rows")).drop("_rows")
    inside = own.withColumn("_n", F.row_number().over(W.partitionBy("_file", "_block").orderBy("_at")) - 1)
    return inside.join(first, ["_file", "_block"]).withColumn(out, F.col("_first") + F.col("_n")).drop("_file", "_block", "_at", "_n", "_first")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def inspect_atac_bundle(spark: SparkSession, folder: str) -> dict:
    """Of each of a bundle's folders that is there: the matrix's shape, columns and rows of obs and var; and the columns that fit for reading."""
    if not exists(spark, folder):
        raise FileNotFoundError(folder)
    parts: dict[str, dict] = {}
    for name in BUNDLE_FOLDERS:
        at = f"{folder}/{name}"
        if not exists(spark, at):
            continue
        parts[name] = {"shape": matrix_header(spark, f"{at}/counts.mtx.gz") if exists(spark, f"{at}/counts.mtx.gz") else None}
        for side in ("obs", "var"):
            if exists(spark, f"{at}/{side}.csv"):
                table = read_delimited(spark, f"{at}/{side}.csv", ",")
                parts[name][side] = {"columns": table.columns, "n_rows": table.count()}
    out: dict = {"folder": folder, "parts": parts}
    if "var" in parts.get("peak_bc", {}):
        columns = parts["peak_bc"]["var"]["columns"]
        out["gene_column"] = guess(columns, ["nearestGene", "gene", "gene_symbol", "nearest_gene"])
        out["distance_column"] = guess(columns, ["distToTSS", "distance", "dist_to_tss"])
    return out


def read_atac_table(spark: SparkSession, path: str, gene: str | None = None, distance: str | None = None, openness: str | None = None) -> DataFrame:
    """The peak-gene links of a flat table, one a row in file order from 0; columns that aren't named are guessed. Empty tables are an error."""
    table = in_file_order(read_table(spark, path), "_row")
    if table.isEmpty():
        raise ValueError(f"{path} has no rows")
    names = [c for c in table.columns if c != "_row"]
    gene, distance = gene or guess(names, GENE_COLUMNS), distance or guess(names, DISTANCE_COLUMNS)
    if gene is None or distance is None:
        raise ValueError(f"{path} has no column of {'genes' if gene is None else 'distances'}")
    require(table, [gene, distance], path)
    return links(table, gene, distance, openness or guess(names, OPENNESS_COLUMNS), "_row")


def require(df: DataFrame, columns: Sequence[str], what: str = "table") -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks the columns {', '.join(missing)}")
    return df


def read_atac_bundle(spark: SparkSession, folder: str, gene: str = "nearestGene", distance: str = "distToTSS") -> tuple[DataFrame, DataFrame]:
    """(cells, peaks) of a bundle's peak_bc folder; the matrix is left for the aggregation."""
    cells = in_file_order(read_delimited(spark, f"{folder}/peak_bc/obs.csv", ","), "cell_row")
    peaks = in_file_order(read_delimited(spark, f"{folder}/peak_bc/var.csv", ","), "peak_row")
    peaks = require(peaks, [gene, distance, "peak_index"], "var.csv")
    barcode = guess(cells.columns, ["cell_id", "cell_barcode", "barcode"])
    if barcode is None:
        raise ValueError("obs.csv has no barcode column")
    return cells.withColumn("cell_id", F.col(barcode)), peaks


def read_atac_counts(spark: SparkSession, folder: str, cells: DataFrame) -> DataFrame:
    """(cell_id, peak_id, value) of a bundle's peak matrix: its rows are cells in the order of obs, its columns peaks in that of var."""
    entries = read_matrix(spark, f"{folder}/peak_bc/counts.mtx.gz")
    named = cells.select("cell_id", F.col("cell_row").alias("row"))
    return entries.join(named, "row").select("cell_id", F.col("col").alias("peak_id"), "value")


def read_edges(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The first of the paths that can be read: Parquet with source, target, edge_type, or source, type, target lines without a header."""
    for path in paths:
        try:
            if path.endswith(".parquet"):
                return require(spark.read.parquet(path), ["source", "target", "edge_type"], path).select(F.col("source").alias("src"), F.col("target").alias("dst"), F.col("edge_type").alias("type"))
            return spark.read.option("sep", "\t").schema("src string, type string, dst string").csv(path).select("src", "dst", "type")
        except Exception as e:  # noqa: BLE001  only a missing path leads to the next one
            if "PATH_NOT_FOUND" not in str(e):
                raise
    raise FileNotFoundError(f"none of {', '.join(paths)}")


def known_relations(spark: SparkSession, path: str | None = None, default: Sequence[str] = tuple(EDGE_TYPES)) -> list[str]:
    """Names of relations: the keys of a JSON object if there is such a file, else the default."""
    if path is None or not exists(spark, path):
        return list(default)
    told = json.loads(spark.read.option("wholetext", True).text(path).first()[0])
    return list(told) if isinstance(told, dict) else list(default)


def read_relations(spark: SparkSession, path: str, src: str, dst: str, kind: str) -> DataFrame:
    return spark.read.option("header", True).csv(path).select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(kind).alias("type"))


def read_entities(spark: SparkSession, files: Mapping[str, tuple[str, str, str]], descriptions: Mapping[str, tuple[str, str, str]] | None = None) -> DataFrame:
    """nodes(id, name, type, desc, pos) from one CSV a type, (path, id column, name column), and descriptions likewise.

    pos is in the order of types, then of the file. A missing file is left out with a warning.
    """
    from helixspark.functions.text import clean_description

    def there(path: str) -> bool:
        if not exists(spark, path):
            warnings.warn(f"{path} is missing", stacklevel=3)
            return False
        return True

    out = spark.createDataFrame([], "id string, name string, type string, desc string, pos long")
    for i, (kind, (path, id_col, name_col)) in enumerate(files.items()):
        if not there(path):
            continue
        rows = in_file_order(spark.read.option("header", True).csv(path), "_pos")
        one = rows.select(F.col(id_col).alias("id"), F.col(name_col).alias("name"), F.lit(kind).alias("type"), (F.col("_pos") + (i << 40)).alias("pos"))
        if descriptions and kind in descriptions and there(descriptions[kind][0]):
            p, a, b = descriptions[kind]
            told = spark.read.option("header", True).csv(p).groupBy(F.col(a).alias("_d")).agg(F.min(b).alias("_t"))
            one = one.join(told, F.col("id") == F.col("_d"), "left").withColumn("desc", clean_description(F.col("_t"))).drop("_d", "_t")
        else:
            one = one.withColumn("desc", F.lit(""))
        out = out.unionByName(one)
    return out


def read_entity_index(spark: SparkSession, path: str) -> DataFrame:
    """(id, row) from a JSON file: an object of id and row, or a list of ids."""
    text = spark.read.option("wholetext", True).text(path)
    is_list = F.trim("value").startswith("[")
    listed = text.where(is_list).select(F.posexplode(F.from_json("value", "array<string>")).alias("row", "id")).select("id", F.col("row").cast("long"))
    named = text.where(~is_list).select(F.explode(F.from_json("value", "map<string,bigint>")).alias("id", "row"))
    return listed.unionByName(named)


def read_hgnc(spark: SparkSession, path: str) -> DataFrame:
    return require(read_delimited(spark, path, "\t"), ["hgnc_id", "symbol", "alias_symbol", "prev_symbol", "ensembl_gene_id"], path)


def gene_descriptions(hgnc: DataFrame) -> DataFrame:
    from helixspark.functions.text import shorten

    return hgnc.groupBy("symbol").agg(F.min("name").alias("_n")).select("symbol", shorten(F.col("_n")).alias("desc"))


def read_gene_aliases(spark: SparkSession, path: str, symbol: str, ensembl: str, id_col: str) -> DataFrame:
    """(name, id): symbols as written and in upper case, and each of the semicolon-separated Ensembl ids."""
    t = read_delimited(spark, path, ",")
    names = F.concat(F.array(F.col(symbol), F.upper(symbol)), F.split(F.coalesce(F.col(ensembl), F.lit("")), ";"))
    return t.select(F.explode(names).alias("name"), F.col(id_col).alias("id")).withColumn("name", F.trim("name")).where("name <> ''").distinct()


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """One seed a line, trimmed; blank lines, and lines that start with #, are left out."""
    return spark.read.text(path).where("not startswith(value, '#') and trim(value) <> ''").select(F.trim("value").alias("seed"))


def read_embeddings(spark: SparkSession, paths: Sequence[str], n_entities: int | None = None) -> DataFrame:
    """(id, vec) of the first table that exists and has as many rows as there are entities."""
    for path in paths:
        try:
            df = require(spark.read.parquet(path), ["id", "vec"], path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        if n_entities is None or df.count() == n_entities:
            return df
    raise FileNotFoundError(f"none of {', '.join(paths)} fits")


def gene_meta(df: DataFrame, orig_id: str, symbol: str | None = None, ensembl: str | None = None, index: str | None = None, token: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """The fixed columns of gene tables, and those to keep."""
    text = lambda c: F.col(c).cast("string") if c else F.lit("")
    number = lambda c: F.col(c).cast("int") if c else F.lit(-1)
    return df.select(F.col(orig_id).cast("string").alias("orig_id"), text(symbol).alias("gene_symbol"), text(ensembl).alias("ensembl_id"), number(index).alias("gctx_index"), number(token).alias("orig_token_id"), F.lit(True).alias("is_hvg"), F.lit("").alias("hgnc_num"), F.lit(0).alias("hgnc_token"), *keep)


def hgnc_numbers(hgnc: DataFrame) -> DataFrame:
    return hgnc.select(after_colon(F.col("hgnc_id")).alias("hgnc_num"), "symbol").where("hgnc_num <> ''")
