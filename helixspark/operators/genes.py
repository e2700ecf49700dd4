"""Mapping genes to a shared vocabulary. Gene tables are small; the expression side is never touched here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixspark.functions.text import after_colon, ensembl_id, present
from helixspark.operators.columns import first_by

#: Tokens of the vocabulary's special entries.
SPECIAL = {"<pad>": 0, "<cls>": 1}
#: Rows of an HGNC table whose names one task makes and sorts.
TASK_ROWS = 50_000


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt to tasks of about TASK_ROWS by hash; a small file is one split however many rows it has."""
    parts = -(-rows.count() // TASK_ROWS)
    return rows.repartition(parts, key) if parts > 1 else rows


def aliases(hgnc: DataFrame, position: str, by_row: bool = False) -> DataFrame:
    """(name, hgnc_num): symbols, then aliases, then former symbols, each also in upper case; later entries overwrite earlier ones.

    ``by_row`` lets all names of a later row overwrite those of an earlier one instead.
    """
    base = hgnc.select(F.col(position).alias("_row"), after_colon(F.col("hgnc_id")).alias("hgnc_num"), "symbol", "alias_symbol", "prev_symbol").where("hgnc_num <> ''")
    listed = lambda c: F.split(F.coalesce(F.col(c), F.lit("")), r"\|")
    stages = [F.array("symbol"), listed("alias_symbol"), listed("prev_symbol")]
    placed = lambda i: lambda x, p: F.struct(F.lit(i).alias("_stage"), p.alias("_pos"), present(F.trim(x)).alias("name"))
    named = F.concat(*(F.transform(names, placed(i)) for i, names in enumerate(stages)))
    every = _spread(base, "_row").select("_row", "hgnc_num", F.explode(named).alias("x")).where("x.name is not null")
    every = every.select("_row", "hgnc_num", "x._stage", "x._pos", F.posexplode(F.array("x.name", F.upper("x.name"))).alias("_upper", "name"))
    order = F.struct("_row", "_stage", "_pos", "_upper") if by_row else F.struct("_stage", "_row", "_pos", "_upper")
    return every.groupBy("name").agg(F.max_by("hgnc_num", order).alias("hgnc_num"))


def map_genes(genes: DataFrame, hgnc: DataFrame, position: str, exact_only: bool = False) -> DataFrame:
    """hgnc_num of each gene: by Ensembl id without version, else by symbol, else by upper-case symbol; "" if unmapped."""
    ids = first_by(_spread(hgnc, position).select(ensembl_id(F.col("ensembl_gene_id")).alias("_ens"), after_colon(F.col("hgnc_id")).alias("_by_id"), position).where("_ens <> '' and _by_id <> ''"), ["_ens"], [position]).drop(position)
    names = aliases(hgnc, position)  # joined by merging: a table that is small as it is shuffled can be large as it is broadcast
    out = genes.withColumn("_e", ensembl_id(F.col("ensembl_id"))).join(ids, F.col("_e") == F.col("_ens"), "left")
    out = out.join(names.select(F.col("name").alias("_n1"), F.col("hgnc_num").alias("_by_name")).hint("merge"), F.col("gene_symbol") == F.col("_n1"), "left")
    found = [F.col("_by_id"), F.col("_by_name")]
    if not exact_only:
        out = out.join(names.select(F.col("name").alias("_n2"), F.col("hgnc_num").alias("_by_upper")).hint("merge"), F.upper("gene_symbol") == F.col("_n2"), "left")
        found.append(F.col("_by_upper"))
    return out.withColumn("hgnc_num", F.coalesce(*found, F.lit(""))).drop("_e", "_ens", "_by_id", "_n1", "_by_name", "_n2", "_by_upper")


def vocabulary(genes: DataFrame, only: Column | None = None) -> DataFrame:
    """(token_key, token_id): tokens from 2 in numeric order of hgnc_num, for mapped (and chosen) genes; keys that aren't digits sort as 0."""
    keys = genes.where((F.col("hgnc_num") != "") & (F.lit(True) if only is None else only)).select(F.col("hgnc_num").alias("token_key")).distinct()
    number = F.coalesce(F.when(F.regexp_like("token_key", F.lit(r"^\d+$")), F.col("token_key").try_cast("long")), F.lit(0))
    return keys.withColumn("token_id", (F.row_number().over(W.orderBy(number, "token_key")) + 1).cast("long"))


def vocabulary_in_order(genes: DataFrame, position: str) -> DataFrame:
    """Tokens from 2 in the order in which keys appear first; repeated keys share a token."""
    first = genes.where("hgnc_num <> ''").groupBy(F.col("hgnc_num").alias("token_key")).agg(F.min(position).alias("_at"))
    return first.withColumn("token_id", (F.row_number().over(W.orderBy("_at", "token_key")) + 1).cast("long")).drop("_at")


def with_tokens(genes: DataFrame, vocab: DataFrame, only: Column | None = None) -> DataFrame:
    """hgnc_token of each gene; 0 where unmapped or not chosen."""
    token = F.coalesce("token_id", F.lit(0))
    token = token if only is None else F.when(only, token).otherwise(F.lit(0))
    return genes.join(vocab, F.col("hgnc_num") == F.col("token_key"), "left").withColumn("hgnc_token", token.cast("long")).drop("token_key", "token_id")


def unmapped(genes: DataFrame, vocab: DataFrame) -> DataFrame:
    return genes.join(vocab, F.col("hgnc_num") == F.col("token_key"), "left_anti")


def coverage(genes: DataFrame) -> DataFrame:
    return genes.agg(F.count("*").alias("n_genes"), F.count_if(F.col("hgnc_num") != "").alias("mapped"), F.count_if(F.col("hgnc_num") == "").alias("unmapped"))
