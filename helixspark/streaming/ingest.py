"""Cells that arrive as array rows are tokenized as they come; no state, no watermark, exactly-once by the sink's batch folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from helixspark.functions.sequences import padded, rank_bin
from helixspark.operators.expression import top_genes_in_row


def tokenized(rows: DataFrame, cell: str, genes: str, values: str, k: int, n_bins: int, use_abs: bool = False) -> DataFrame:
    """gene_ids, bin_ids and lengths of rows of arrays, batch or stream, without a shuffle."""
    top = rows.select(F.col(cell).alias("cell_id"), top_genes_in_row(rows, genes, values, k, use_abs).alias("_t"))
    n = F.size("_t")
    bins = F.transform("_t", lambda x, i: rank_bin(i + 1, n, n_bins).cast("int"))
    return top.select("cell_id", padded(F.transform("_t", lambda x: x["g"].cast("int")), k).alias("gene_ids"), padded(bins, k).alias("bin_ids"), n.cast("short").alias("lengths"))


def start(rows: DataFrame, path: str, checkpoint: str, **options: object) -> StreamingQuery:
    """Write token rows of a stream, one folder for each batch, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        tokenized(batch, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
