"""Writers. Nothing is written over what it is read from: intermediates go to versioned folders."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.operators.atac import preview
from helixspark.sources.tables import Source, exists


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small driver-made file (summary, map, descriptor) as one text part."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def intermediates(folder: str, version: str, cells: DataFrame, genes: DataFrame, source: Source) -> str:
    """cell_meta, gene_meta and data_source under folder/version; returns that path."""
    base = f"{folder}/{version}"
    cells.write.mode("errorifexists").parquet(f"{base}/cell_meta.parquet")
    genes.write.mode("errorifexists").parquet(f"{base}/gene_meta.parquet")
    write_text(cells.sparkSession, f"{base}/data_source.json", source.to_json())
    return base


def shards(rows: DataFrame, path: str, compression: str = "zstd") -> None:
    """One folder a shard; rows of a shard meet in one task, so that each is one file."""
    rows.repartition("shard_id").write.mode("errorifexists").option("compression", compression).partitionBy("shard_id").parquet(path)


def vocabulary(vocab: DataFrame, path: str) -> None:
    """One JSON object of token_key and token_id."""
    json_map(vocab, "token_key", "token_id", path)


def json_object(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row with a JSON object of keys and values, for maps of genes, labels or domains, which are small; of equal keys the last value by order counts."""
    once = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("k")).agg(F.max(value).alias("v"))
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v"))))
    return once.agg(F.to_json(entries, {"ignoreNullFields": "false"}).alias("value"))


def json_map(df: DataFrame, key: str, value: str, path: str) -> None:
    json_object(df, key, value).coalesce(1).write.mode("overwrite").text(path)


def gene_maps(genes: DataFrame, folder: str) -> None:
    """The maps that go with a set of genes: original id to vocabulary key, and how each gene was mapped."""
    json_map(genes.where("hgnc_num <> ''"), "orig_id", "hgnc_num", f"{folder}/id_map.json")
    genes.select("orig_id", "gene_symbol", "ensembl_id", "hgnc_num", "hgnc_token").coalesce(1).write.mode("overwrite").json(f"{folder}/gene_mapping_info.json")


def domain_map(rows: DataFrame, label: str, id_: str, path: str) -> None:
    json_map(rows.select(label, id_).distinct(), label, id_, path)


def tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def lookup_table(df: DataFrame, index: str, token: str, path: str) -> None:
    df.select(F.col(index).alias("index"), F.col(token).alias("token")).write.mode("overwrite").parquet(path)


def gene_scores(scores: DataFrame, folder: str, top_n: int = 50) -> None:
    """Tab-separated text, Parquet, and a preview of the best as JSON."""
    tsv(scores, f"{folder}/gene_scores.tsv")
    scores.write.mode("overwrite").parquet(f"{folder}/gene_scores.parquet")
    preview(scores, top_n).orderBy("rank").coalesce(1).write.mode("overwrite").json(f"{folder}/summary.json")


def append_json(df: DataFrame, path: str, attempt: str | None = None) -> bool:
    """Appends rows as lines of JSON, in a folder named by the attempt; false if that attempt is there already, whole.

    An attempt that died before its end is written again, so no line stands twice. Without a name, rows are always added.
    """
    if attempt is None:
        df.write.mode("append").json(f"{path}/attempt={uuid.uuid4().hex}")
        return True
    at = f"{path}/attempt={attempt}"
    if exists(df.sparkSession, f"{at}/_SUCCESS"):
        return False
    df.write.mode("overwrite").json(at)
    return True


def appended(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The lines of all whole attempts, None if there are none."""
    if not exists(spark, path):
        return None
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = [str(f.getPath()) for f in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)]
    whole = [f for f in sorted(found) if exists(spark, f"{f}/_SUCCESS")]
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(whole) if whole else None


def cached_index(spark: SparkSession, make: Callable[[], DataFrame], path: str, version: str) -> DataFrame:
    """The index table under ``path`` if it was written with this version, else a new one, which replaces it.

    The table's folder is named by the version and the note that names it is written last, so a job that dies leaves the old one in force.
    """
    note, table = f"{path}/version", f"{path}/{version}"
    if exists(spark, f"{note}/_SUCCESS") and [r[0] for r in spark.read.text(note).collect()] == [version]:
        return spark.read.parquet(table)
    make().write.mode("overwrite").parquet(table)
    write_text(spark, note, version)
    return spark.read.parquet(table)


def edge_index(spark: SparkSession, make: Callable[[], DataFrame], name: str, path: str, version: str, buckets: int = 200) -> DataFrame:
    """Edges (src, dst, type) as a table bucketed and sorted by src under ``path``, made once for a version and number of buckets.

    A join on src doesn't shuffle it, nor sort it in sessions with spark.sql.legacy.bucketedTableScan.outputOrdering: one file a bucket. The note that names a version is written last, so a job
    that dies leaves the old one in force. The catalogue's entry is made anew where a session doesn't have it.
    """
    key = f"{version}/{buckets}"
    note, table = f"{path}/version", f"{path}/{version}-{buckets}"
    known = exists(spark, f"{note}/_SUCCESS") and [r[0] for r in spark.read.text(note).collect()] == [key]
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    if known:
        spark.sql(f"CREATE TABLE {name} (src STRING, dst STRING, type STRING) USING parquet CLUSTERED BY (src) SORTED BY (src, dst, type) INTO {buckets} BUCKETS LOCATION '{table}'")
    else:
        edges = make().select("src", "dst", "type")
        edges.repartition(buckets, "src").write.mode("overwrite").format("parquet").bucketBy(buckets, "src").sortBy("src", "dst", "type").option("path", table).saveAsTable(name)
        write_text(spark, note, key)
    return spark.table(name)


def gene_list(genes: DataFrame, column: str, path: str) -> None:
    genes.select(F.col(column).cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def rewrite_shards(src: str, dst: str, spark: SparkSession) -> None:
    """Shards with dose_um, dose_raw and time_h added, in a new place."""
    from helixspark.functions.text import dose_raw, dose_um, hours

    rows = spark.read.parquet(src)
    new = {"dose_um": dose_um(F.col("dose")).cast("float"), "dose_raw": dose_raw(F.col("dose")).cast("float"), "time_h": hours(F.col("time")).cast("float")}
    rows.withColumns(new).write.mode("errorifexists").partitionBy("shard_id").parquet(dst)
