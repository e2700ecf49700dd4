"""Whole pipelines as parameterised plans."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixspark.operators import atac, columns, expression, genes, graph
from helixspark.sources import sinks
from helixspark.sources.staging import staged


@dataclass
class TokenOptions:
    top_k: int = 1024
    n_bins: int = 32
    shard_size: int = 50_000
    use_abs: bool = False
    n_hvg: int = 3000
    sample: int = 50_000
    bounds: Mapping[str, float] = field(default_factory=lambda: {"min_genes": 500, "max_genes": 8000, "min_counts": 1000, "max_counts": 100_000, "max_pct_mt": 20})
    domain: str | None = None
    keep_empty: bool = False
    mito: str = "MT-"
    seed: int = 42
    stage: str | None = None


def tokenize(expr: DataFrame, cells: DataFrame, gene_table: DataFrame, hgnc: DataFrame, options: TokenOptions, cell_block: Column, position: str = "pos") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(token rows, genes with tokens, vocabulary) from long-form expression, cells and genes (with gene_idx).

    Metrics and filter, variable genes on a uniform sample, mapping, then the strongest genes of each cell. The cell side
    shuffles by cell_id alone; gene tables are small. The vocabulary is fixed before tokens are made. The cells that pass
    are asked for four times: with ``stage``, a folder that all executors share, they are written there once, and the
    expression table is scanned for variance and tokens only.
    """
    mito = expression.mito_genes(gene_table, options.mito).select("gene_idx")
    kept = expression.filter_cells(expression.drop_doublets(expression.cell_metrics(expr, cells, mito)), **options.bounds)
    if options.stage:
        path = f"{options.stage.rstrip('/')}/cells-{uuid.uuid4().hex}"
        kept.write.parquet(path)
        kept = kept.sparkSession.read.parquet(path)
    sampled = expression.uniform_sample(kept.select("cell_id", F.xxhash64("cell_id").alias("_h")).withColumn("_h", F.pmod("_h", F.lit(1 << 31))), "_h", options.sample, options.seed)
    variance = expression.gene_variance(expression.keep_cells(expr, sampled), max(1, sampled.count()))
    hvg = expression.top_variable(variance, options.n_hvg)
    table = genes.map_genes(gene_table.drop("is_hvg", "hgnc_num", "hgnc_token").join(hvg.select("gene_idx", "is_hvg", "variance"), "gene_idx", "left").withColumn("is_hvg", F.coalesce("is_hvg", F.lit(False))), hgnc, position)
    vocab = genes.vocabulary(table, F.col("is_hvg"))
    table = genes.with_tokens(table, vocab, F.col("is_hvg"))
    top = expression.top_genes(expression.keep_cells(expr, kept), options.top_k, options.n_bins, options.use_abs, tokens=table.select("gene_idx", F.col("hgnc_token").alias("token")))
    rows = expression.token_rows(top, options.top_k, "token", kept if options.keep_empty else None)
    meta = kept.select("cell_id", columns.text_columns(kept).alias("text_data"), *([options.domain] if options.domain else []))
    rows = rows.join(meta, "cell_id")
    rows = columns.encode_sorted(rows, options.domain, "domain_id") if options.domain else rows.withColumn("domain_id", F.lit(0).cast("long"))
    return expression.with_shards(rows, options.shard_size, cell_block), table, vocab


def gene_activity(counts: DataFrame, cells: DataFrame, link: DataFrame, min_peaks: int = 1, use_abs: bool = True) -> DataFrame:
    """Cell checks, openness of peaks over passing cells, scores of genes."""
    passing = atac.require_passing(atac.check_cells(cells))
    return atac.gene_scores(atac.with_openness(link, atac.peak_openness(counts, passing)), min_peaks, use_abs)


def subgraphs(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, embeddings: DataFrame | None = None, small: bool = False, **options: object) -> DataFrame:
    """One record a seed: name, type, counts, text, raw nodes and edges, with embeddings' coverage if given. Seeds that aren't found have a status."""
    found = graph.resolve_seeds(seeds, nodes, graph.SMALL_TYPE_ORDER if small else graph.TYPE_ORDER, fuzzy_rank=small)
    n, e = graph.expand(found.where("status = 'ok'").select("seed", "id"), nodes, edges, **options)
    raw_nodes = n.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "name", "type", "desc"))).alias("raw_nodes"))
    raw_edges = e.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("ord", "src", "dst", "type"))).alias("raw_edges"))
    out = found.select("seed", F.col("id").alias("seed_id"), F.col("name").alias("seed_name"), F.col("type").alias("seed_type"), "status", F.lit(int(options.get("max_hops", 2))).alias("hops"))
    for more in (graph.render(n, e), raw_nodes, raw_edges):
        out = out.join(more, "seed", "left")
    return out.join(graph.attach_embeddings(n, embeddings)[1], "seed", "left") if embeddings is not None else out


def subgraph_batches(seeds: DataFrame, out: str, make: Callable[[DataFrame], DataFrame], batches: int = 1, salt: int = 0) -> DataFrame:
    """Records of all seeds as lines of JSON under ``out``, batch by batch; a run that died is continued by running it again.

    ``make`` gives one record a seed, as ``subgraphs`` does. Seeds with a record are left out by an anti-join, so none gets two. A
    batch that fails is halved until the seed at fault is alone; that one's record has status failed and what was raised.
    """
    spark = seeds.sparkSession
    once = seeds.select("seed").where("seed is not null").distinct()
    for k in range(batches):
        part = once.where(F.pmod(F.xxhash64("seed"), F.lit(batches)) == k)
        done = sinks.appended(spark, out, "seed string")
        todo = part if done is None else part.join(done, "seed", "left_anti")
        if not todo.isEmpty():
            _attempt(todo, out, make, salt)
    return sinks.appended(spark, out)


def _attempt(todo: DataFrame, out: str, make: Callable[[DataFrame], DataFrame], level: int) -> None:
    todo = staged(todo, "seeds")
    try:
        sinks.append_json(make(todo), out, uuid.uuid4().hex)
        return
    except Exception as e:  # noqa: BLE001  whatever a seed raises is its record's
        told = f"{type(e).__name__}: {e}"[:500]
    if todo.limit(2).count() < 2:
        sinks.append_json(todo.select("seed", F.lit("failed").alias("status"), F.lit(told).alias("error")), out, uuid.uuid4().hex)
        return
    while True:  # another hash until both halves have seeds
        half = F.pmod(F.xxhash64("seed", F.lit(level)), F.lit(2))
        if todo.select(half.alias("h")).distinct().count() == 2:
            break
        level += 1
    for h in range(2):
        _attempt(todo.where(half == h), out, make, level + 1)
