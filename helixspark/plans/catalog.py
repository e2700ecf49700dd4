"""Registered queries over the supplied tables, each with SQL that gives the same rows.

Stand-ins: expression is ``lineitem`` (cell l_orderkey, gene l_partkey, value summed l_quantity) and, dense, ``embeddings``;
cells are ``orders``; genes are ``part``; peaks are ``lineitem`` rows; the graph is made of foreign keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.functions import celltypes, sequences, text
from helixspark.operators import atac, columns, expression, genes, graph, metrics, order
from helixspark.sources import datasets, sinks
from helixspark.sources.staging import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def big(c: str) -> Column:
    return F.col(c).cast("long").alias(c)


def r6(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


def expr(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return expression.summed(li.select(F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("gene_idx"), F.col("l_quantity").alias("value")))


EXPR = "expr AS (SELECT l_orderkey AS cell_id, l_partkey AS gene_idx, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)"
TOP = f"{EXPR}, ranked AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY value DESC, gene_idx) AS rank FROM expr WHERE value <> 0), top AS (SELECT *, count(*) OVER (PARTITION BY cell_id) AS len FROM ranked WHERE rank <= 4), binned AS (SELECT cell_id, gene_idx, rank, 32 - ((rank - 1) * 32) // len AS bin FROM top)"


@query(f"WITH {TOP} SELECT cell_id, gene_idx, rank, CAST(bin AS BIGINT) AS bin FROM binned")
def tok_topk_rankbin(spark, sf):
    return expression.top_genes(expr(spark, sf), 4, 32)


@query(f"WITH {TOP} SELECT cell_id, string_agg(CAST(gene_idx AS VARCHAR), ',' ORDER BY rank) || repeat(',0', CAST(4 - count(*) AS INT)) AS gene_ids, string_agg(CAST(bin AS VARCHAR), ',' ORDER BY rank) || repeat(',0', CAST(4 - count(*) AS INT)) AS bin_ids, count(*) AS length, CAST((row_number() OVER (ORDER BY cell_id) - 1) // 500 AS BIGINT) AS shard_id FROM binned GROUP BY cell_id")
def tok_padded_arrays(spark, sf):
    rows = expression.token_rows(expression.top_genes(expr(spark, sf), 4, 32), 4)
    rows = expression.with_shards(rows, 500, F.floor(F.col("cell_id") / 4096))
    return rows.select("cell_id", F.array_join("gene_ids", ",").alias("gene_ids"), F.array_join("bin_ids", ",").alias("bin_ids"), F.col("lengths").cast("long").alias("length"), "shard_id")


DENSE = "dense AS (SELECT vec_id AS cell_id, unnest(range(0, len(embedding))) AS gene_idx, unnest(embedding) AS value FROM embeddings)"


@query(f"WITH {DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY abs(value) DESC, gene_idx) AS rank FROM dense WHERE value <> 0), t AS (SELECT *, count(*) OVER (PARTITION BY cell_id) AS len FROM r WHERE rank <= 8) SELECT cell_id, gene_idx, rank, CAST(32 - ((rank - 1) * 32) // len AS BIGINT) AS bin FROM t")
def tok_dense_abs_topk(spark, sf):
    long = expression.to_long(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return expression.top_genes(long, 8, 32, use_abs=True).withColumn("gene_idx", F.col("gene_idx").cast("long"))


@query(f"WITH {DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY abs(value) DESC, gene_idx) AS n FROM dense), m AS (SELECT cell_id, gene_idx, gene_idx + 1 AS token, row_number() OVER (PARTITION BY cell_id ORDER BY abs(value) DESC, gene_idx) AS rank FROM r WHERE n <= 12 AND gene_idx % 3 <> 0), t AS (SELECT *, count(*) OVER (PARTITION BY cell_id) AS len FROM m WHERE rank <= 8) SELECT cell_id, token, rank, CAST(16 - ((rank - 1) * 16) // len AS BIGINT) AS bin FROM t")
def tok_overselect(spark, sf):
    long = expression.to_long(table(spark, sf, "embeddings"), "vec_id", "embedding")
    tokens = spark.range(64).select(F.col("id").cast("int").alias("gene_idx"), F.when(F.col("id") % 3 != 0, F.col("id") + 1).otherwise(0).alias("token"))
    return expression.top_genes(long, 8, 16, use_abs=True, over=4, tokens=tokens).select("cell_id", "token", "rank", "bin")


@query(SQL["tok_overselect"])
def tok_overselect_dense(spark, sf):
    tokens = spark.range(64).select(F.col("id").cast("int").alias("gene_idx"), F.when(F.col("id") % 3 != 0, F.col("id") + 1).otherwise(0).alias("token"))
    top = expression.top_genes_dense(table(spark, sf, "embeddings"), "vec_id", "embedding", tokens, 8, 16, 4, use_abs=True)
    both = F.posexplode(F.arrays_zip(F.slice("gene_ids", 1, F.col("lengths").cast("int")).alias("t"), F.slice("bin_ids", 1, F.col("lengths").cast("int")).alias("b")))
    return top.select(F.col("vec_id").alias("cell_id"), both.alias("i", "x")).select("cell_id", F.col("x.t").cast("long").alias("token"), (F.col("i") + 1).cast("long").alias("rank"), F.col("x.b").cast("long").alias("bin"))


@query(f"WITH {DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY abs(value) DESC, gene_idx) AS rank FROM dense WHERE value <> 0) SELECT cell_id, string_agg(CAST(gene_idx AS VARCHAR), ',' ORDER BY rank) AS gene_ids FROM r WHERE rank <= 8 GROUP BY cell_id")
def tok_in_row(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("genes", F.sequence(F.lit(0), F.size("embedding") - 1))
    top = expression.top_genes_in_row(e, "genes", "embedding", 8, use_abs=True)
    return e.select(F.col("vec_id").alias("cell_id"), F.array_join(F.transform(top, lambda x: x["g"].cast("string")), ",").alias("gene_ids"))


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("cell_id"), (F.col("o_orderstatus") == "P").alias("predicted_doublet"))


def with_metrics(spark: SparkSession, sf: str) -> DataFrame:
    mito = table(spark, sf, "part").where(F.col("p_type").startswith("PROMO")).select(F.col("p_partkey").alias("gene_idx"))
    return expression.cell_metrics(expr(spark, sf), cells(spark, sf), mito)


METRICS = f"{EXPR}, s AS (SELECT cell_id, count(*) FILTER (value > 0) AS n_genes, sum(value) AS n_counts, coalesce(sum(value) FILTER (p_type LIKE 'PROMO%'), 0) AS mt FROM expr JOIN part ON gene_idx = p_partkey GROUP BY 1), m AS (SELECT o_orderkey AS cell_id, o_orderstatus = 'P' AS predicted_doublet, CAST(coalesce(n_genes, 0) AS BIGINT) AS n_genes, coalesce(n_counts, 0) AS n_counts, CASE WHEN n_counts > 0 THEN 100 * mt / n_counts ELSE 0 END AS pct_mt FROM orders LEFT JOIN s ON o_orderkey = cell_id)"


@query(f"WITH {METRICS} SELECT cell_id, n_genes, n_counts, round(pct_mt, 6) AS pct_mt FROM m")
def cell_qc_metrics(spark, sf):
    return with_metrics(spark, sf).select("cell_id", big("n_genes"), "n_counts", r6("pct_mt"))


@query(f"WITH {METRICS} SELECT median(n_genes) AS n_genes, median(n_counts) AS n_counts, round(median(pct_mt), 6) AS pct_mt FROM m")
def cell_qc_medians(spark, sf):
    names = ["n_genes", "n_counts", "pct_mt"]
    return expression.medians(with_metrics(spark, sf), names).withColumn("pct_mt", F.round("pct_mt", 6))


@query(f"WITH {METRICS} SELECT cell_id, n_genes, n_counts FROM m WHERE NOT predicted_doublet AND n_genes >= 2 AND n_genes <= 6 AND n_counts >= 40 AND pct_mt <= 50")
def cell_qc_filter(spark, sf):
    kept = expression.filter_cells(expression.drop_doublets(with_metrics(spark, sf)), min_genes=2, max_genes=6, min_counts=40, max_pct_mt=50)
    return kept.select("cell_id", big("n_genes"), "n_counts")


@query(f"WITH {METRICS}, k AS (SELECT * FROM m WHERE NOT predicted_doublet AND n_genes >= 2 AND pct_mt <= 50) SELECT (SELECT count(*) FROM m) AS n_before, (SELECT count(*) FROM k) AS n_after, (SELECT count(*) FROM m) - (SELECT count(*) FROM k) AS n_removed, printf('%.1f%%', 100.0 * (SELECT count(*) FROM k) / (SELECT count(*) FROM m)) AS pct_kept")
def cell_qc_summary(spark, sf):
    keep = ~F.coalesce("predicted_doublet", F.lit(False)) & expression.cell_passes(min_genes=2, max_pct_mt=50)
    n, k = F.count("*"), F.count_if(keep)
    return with_metrics(spark, sf).agg(n.alias("n_before"), k.alias("n_after"), (n - k).alias("n_removed"), text.percent(k / n).alias("pct_kept"))


@query(f"WITH {EXPR} SELECT cell_id, gene_idx, value FROM expr WHERE cell_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cell_semi_join(spark, sf):
    kept = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("cell_id"))
    return expression.keep_cells(expr(spark, sf), kept)


@query(f"WITH {EXPR}, v AS (SELECT gene_idx, greatest(sum(value * value) / (SELECT count(*) FROM orders) - power(sum(value) / (SELECT count(*) FROM orders), 2), 0) AS variance FROM expr GROUP BY 1) SELECT gene_idx, round(variance, 6) AS variance, row_number() OVER (ORDER BY round(variance, 9) DESC, gene_idx DESC) <= 100 AS is_hvg FROM v")
def gene_variance_hvg(spark, sf):
    v = expression.gene_variance(expr(spark, sf), table(spark, sf, "orders").count())
    return expression.top_variable(v, 100).select("gene_idx", r6("variance"), "is_hvg")


@query("WITH h AS (SELECT o_orderkey, o_orderpriority, (((o_orderkey * 1103515245 + 42 * 12345) % 2147483647) * 48271) % 2147483647 AS h FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY h, o_orderkey) AS n FROM h) SELECT o_orderkey, o_orderpriority FROM r WHERE n <= greatest(1, 500 // (SELECT count(DISTINCT o_orderpriority) FROM orders)) ORDER BY h, o_orderkey LIMIT 500")
def stratified_sample(spark, sf):
    return expression.stratified_sample(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority", 500)


@query("SELECT o_orderkey FROM orders ORDER BY (((o_orderkey * 1103515245 + 42 * 12345) % 2147483647) * 48271) % 2147483647, o_orderkey LIMIT 300")
def uniform_sample(spark, sf):
    return expression.uniform_sample(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 300)


@query(f"WITH {EXPR} SELECT cell_id, gene_idx, round(ln(1 + value * 10000 / sum(value) OVER (PARTITION BY cell_id)), 6) AS value FROM expr")
def norm_log1p(spark, sf):
    return expression.normalized(expr(spark, sf)).select("cell_id", "gene_idx", r6("value"))


def hgnc(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    s = k.cast("string")
    return p.select(k.alias("pos"), F.concat(F.lit("HGNC:"), s).alias("hgnc_id"), F.concat(F.lit("sym"), s).alias("symbol"), F.concat(F.lit("al"), (k % 50).cast("string"), F.lit("|sym"), (k + 1).cast("string")).alias("alias_symbol"), F.concat(F.lit("Old"), (k % 70).cast("string")).alias("prev_symbol"), F.concat(F.lit("ENSG"), (k % 900).cast("string"), F.lit("."), (k % 7).cast("string")).alias("ensembl_gene_id"))


HGNC = "hgnc AS (SELECT p_partkey AS pos, CAST(p_partkey AS VARCHAR) AS num, 'sym' || p_partkey AS symbol, 'al' || (p_partkey % 50) AS a1, 'sym' || (p_partkey + 1) AS a2, 'Old' || (p_partkey % 70) AS prev, 'ENSG' || (p_partkey % 900) AS ens FROM part)"
ALIAS = f"{HGNC}, names AS (SELECT symbol AS name, num, 0 AS st, pos, 0 AS p FROM hgnc UNION ALL SELECT a1, num, 1, pos, 0 FROM hgnc UNION ALL SELECT a2, num, 1, pos, 1 FROM hgnc UNION ALL SELECT prev, num, 2, pos, 0 FROM hgnc), both_ AS (SELECT name, num, st, pos, p, 0 AS u FROM names UNION ALL SELECT upper(name), num, st, pos, p, 1 FROM names), alias AS (SELECT name, num AS hgnc_num FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY st DESC, pos DESC, p DESC, u DESC) AS n FROM both_) WHERE n = 1)"


@query(f"WITH {ALIAS} SELECT name, hgnc_num FROM alias")
def gene_alias_map(spark, sf):
    return genes.aliases(hgnc(spark, sf), "pos")


@query(f"WITH {HGNC}, names AS (SELECT symbol AS name, num, 0 AS st, pos, 0 AS p FROM hgnc UNION ALL SELECT a1, num, 1, pos, 0 FROM hgnc UNION ALL SELECT a2, num, 1, pos, 1 FROM hgnc UNION ALL SELECT prev, num, 2, pos, 0 FROM hgnc), both_ AS (SELECT name, num, st, pos, p, 0 AS u FROM names UNION ALL SELECT upper(name), num, st, pos, p, 1 FROM names) SELECT name, num AS hgnc_num FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pos DESC, st DESC, p DESC, u DESC) AS n FROM both_) WHERE n = 1")
def gene_alias_map_by_row(spark, sf):
    return genes.aliases(hgnc(spark, sf), "pos", by_row=True)


def gene_table(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    ens = F.when(k % 4 == 0, F.lit(" NA ")).otherwise(F.concat(F.lit("ENSG"), (k % 1300).cast("string"), F.lit(".9")))
    sym = F.when(k % 3 == 0, F.concat(F.lit("Sym"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("OLD"), (k % 90).cast("string"))).otherwise(F.lit("zz"))
    return table(spark, sf, "part").select(k.alias("gene_idx"), ens.alias("ensembl_id"), sym.alias("gene_symbol"), "p_size")


MAPPED = f"{ALIAS}, g AS (SELECT p_partkey AS gene_idx, p_size, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'ENSG' || (p_partkey % 1300) END AS e, CASE p_partkey % 3 WHEN 0 THEN 'Sym' || p_partkey WHEN 1 THEN 'OLD' || (p_partkey % 90) ELSE 'zz' END AS s FROM part), ids AS (SELECT ens, num FROM (SELECT *, row_number() OVER (PARTITION BY ens ORDER BY pos) AS n FROM hgnc) WHERE n = 1), mapped AS (SELECT gene_idx, p_size, coalesce(ids.num, a.hgnc_num, b.hgnc_num, '') AS hgnc_num FROM g LEFT JOIN ids ON e = ens LEFT JOIN alias a ON s = a.name LEFT JOIN alias b ON upper(s) = b.name)"


@query(f"WITH {MAPPED} SELECT gene_idx, hgnc_num FROM mapped")
def gene_ensembl_map(spark, sf):
    return genes.map_genes(gene_table(spark, sf), hgnc(spark, sf), "pos").select("gene_idx", "hgnc_num")


@query(f"WITH {MAPPED}, v AS (SELECT hgnc_num, row_number() OVER (ORDER BY CAST(hgnc_num AS BIGINT), hgnc_num) + 1 AS token_id FROM (SELECT DISTINCT hgnc_num FROM mapped WHERE hgnc_num <> '' AND p_size <= 25)) SELECT gene_idx, CASE WHEN p_size <= 25 THEN coalesce(token_id, 0) ELSE 0 END AS hgnc_token FROM mapped LEFT JOIN v USING (hgnc_num)")
def vocab_build(spark, sf):
    mapped = genes.map_genes(gene_table(spark, sf), hgnc(spark, sf), "pos")
    chosen = F.col("p_size") <= 25
    return genes.with_tokens(mapped, genes.vocabulary(mapped, chosen), chosen).select("gene_idx", "hgnc_token")


@query(f"WITH {MAPPED} SELECT hgnc_num AS token_key, row_number() OVER (ORDER BY min(gene_idx), hgnc_num) + 1 AS token_id FROM mapped WHERE hgnc_num <> '' GROUP BY 1")
def vocab_in_order(spark, sf):
    return genes.vocabulary_in_order(genes.map_genes(gene_table(spark, sf), hgnc(spark, sf), "pos"), "gene_idx")


@query(f"WITH {MAPPED} SELECT count(*) AS n_genes, count(*) FILTER (hgnc_num <> '') AS mapped, count(*) FILTER (hgnc_num = '') AS unmapped FROM mapped")
def gene_coverage(spark, sf):
    return genes.coverage(genes.map_genes(gene_table(spark, sf), hgnc(spark, sf), "pos"))


@query(f"WITH {MAPPED} SELECT gene_idx FROM mapped WHERE hgnc_num NOT IN (SELECT hgnc_num FROM mapped WHERE hgnc_num <> '' AND p_size <= 25)")
def gene_unmapped(spark, sf):
    mapped = genes.map_genes(gene_table(spark, sf), hgnc(spark, sf), "pos")
    return genes.unmapped(mapped, genes.vocabulary(mapped, F.col("p_size") <= 25)).select("gene_idx")


@query("SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS BIGINT) AS domain_id FROM customer")
def label_encode_sorted(spark, sf):
    return columns.encode_sorted(table(spark, sf, "customer"), "c_mktsegment", "domain_id").select("c_custkey", "domain_id")


@query("WITH f AS (SELECT c_mktsegment, min(c_custkey) AS first_at FROM customer GROUP BY 1), i AS (SELECT c_mktsegment, row_number() OVER (ORDER BY first_at) - 1 AS domain_id FROM f) SELECT c_custkey, domain_id FROM customer JOIN i USING (c_mktsegment)")
def label_encode_first(spark, sf):
    return columns.encode_first(table(spark, sf, "customer"), "c_mktsegment", "c_custkey", "domain_id").select("c_custkey", "domain_id")


@query("SELECT o_orderkey, coalesce(nullif(o_orderpriority, ''), 'none') || '|' || coalesce(c_mktsegment, 'none') || '|' || CASE WHEN o_orderkey % 5 = 0 THEN 'none' ELSE 'p' || (o_orderkey % 5) END AS domain FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal >= 0")
def domain_string(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").withColumn("c_custkey", F.expr("CASE WHEN c_acctbal >= 0 THEN c_custkey END"))
    plate = F.when(F.col("o_orderkey") % 5 == 0, F.lit(" NaN ")).otherwise(F.concat(F.lit("p"), (F.col("o_orderkey") % 5).cast("string")))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", text.joined_domain(F.col("o_orderpriority"), F.col("c_mktsegment"), plate).alias("domain"))


@query("WITH r AS (SELECT c_nationkey, c_name, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer) SELECT s_suppkey, c_name, c_mktsegment, coalesce(n_name, 'none') AS nation FROM supplier LEFT JOIN r ON s_nationkey = c_nationkey AND n = 1 LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey <> 2")
def metadata_left_join(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_nationkey", "s_nationkey")
    out = columns.enrich(table(spark, sf, "supplier"), c, "s_nationkey", order=["c_custkey"])
    out = columns.lookup(out, table(spark, sf, "nation").withColumn("s_nationkey", F.expr("CASE WHEN n_regionkey <> 2 THEN n_nationkey END")), "s_nationkey", "n_name", "nation")
    return out.select("s_suppkey", "c_name", "c_mktsegment", "nation")


CELLTYPE = "CASE c_custkey % 8 WHEN 0 THEN 'NK' WHEN 1 THEN 'T-cell' WHEN 2 THEN 'cd4+_T' WHEN 3 THEN 'weird__type' WHEN 4 THEN ' Kupffer ' WHEN 5 THEN '' WHEN 6 THEN 'mine' ELSE c_mktsegment END"


@query(f"SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'Natural Killer Cell' WHEN 1 THEN 'T Cell' WHEN 2 THEN 'CD4+ T Cell' WHEN 3 THEN 'weird type' WHEN 4 THEN 'Kupffer Cell' WHEN 5 THEN '' WHEN 6 THEN 'My Cell' ELSE trim(regexp_replace(regexp_replace(c_mktsegment, '[-_]+', ' ', 'g'), '\\s+', ' ', 'g')) END AS cell_type FROM customer")
def celltype_normalize(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", celltypes.canonical(F.expr(CELLTYPE), {"mine": "My Cell"}).alias("cell_type"))


@query("WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_linenumber % 6 AS u FROM lineitem) SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN u = 5 THEN NULL ELSE q END AS dose_raw, CASE u WHEN 0 THEN q WHEN 1 THEN round(q * 0.001, 6) WHEN 2 THEN q * 1000 WHEN 4 THEN q * 1000000 END AS dose_um, CASE WHEN u IN (0, 2) THEN q END AS time_h FROM t")
def dose_time_parse(spark, sf):
    q, u = F.col("l_quantity").cast("string"), F.col("l_linenumber") % 6
    unit = F.when(u == 0, " uM").when(u == 1, " nM").when(u == 2, " mM ").when(u == 3, " ng/ml").when(u == 4, "  M").otherwise("uM")
    time = F.when(u == 0, " h").when(u == 1, " hours").when(u == 2, "H").otherwise(" d")
    d = table(spark, sf, "lineitem").select("l_orderkey", big("l_linenumber"), F.concat(q, unit).alias("dose"), F.concat(q, time).alias("time"))
    return d.select("l_orderkey", "l_linenumber", text.dose_raw(F.col("dose")).alias("dose_raw"), r6(text.dose_um(F.col("dose")), "dose_um"), text.hours(F.col("time")).alias("time_h"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'none' WHEN c_custkey % 3 = 1 THEN (c_custkey % 10) || '.5 uM' ELSE (c_custkey % 10) || '.5 uM, 2 nM' END AS dose FROM customer")
def drug_dose_list(spark, sf):
    k = (F.col("c_custkey") % 10).cast("string")
    one = F.concat(F.lit("[('Drug (a), b', "), k, F.lit(".5, 'uM')"))
    raw = F.when(F.col("c_custkey") % 3 == 0, F.lit("none")).when(F.col("c_custkey") % 3 == 1, F.concat(one, F.lit("]"))).otherwise(F.concat(one, F.lit(", (\"D'x\", 2, 'nM')]")))
    return table(spark, sf, "customer").select("c_custkey", text.drug_doses(raw).alias("dose"))


FIRST = "CASE WHEN strpos({x}, '. ') - 1 > 20 AND strpos({x}, '. ') - 1 < 220 THEN substr({x}, 1, strpos({x}, '. ')) ELSE substr({x}, 1, 220) END"


@query("WITH d AS (SELECT doc_id, trim(regexp_replace(text, '[\\s]+', ' ', 'g')) AS x, trim(split_part(regexp_replace('NCBI Gene: ' || replace(text, chr(10), ' ') || ' [Source:HGNC;Acc:1] | rest', '^[A-Za-z0-9 _]+:\\s*', ''), ' [Source:HGNC', 1)) AS y FROM documents), e AS (SELECT doc_id, x, trim(split_part(y, '|', 1)) AS z FROM d) SELECT doc_id, " + FIRST.format(x="x") + " AS short, " + FIRST.format(x="z") + " AS clean FROM e")
def desc_clean(spark, sf):
    told = F.concat(F.lit("NCBI Gene: "), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(" [Source:HGNC;Acc:1] | rest"))
    return table(spark, sf, "documents").select("doc_id", text.shorten(F.col("text")).alias("short"), text.clean_description(told).alias("clean"))


ATAC_CELLS = "SELECT o_orderkey AS cell_id, o_totalprice / 40000 AS tss_enrichment, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey % 100) / 200.0 END AS frip, o_totalprice AS n_fragments FROM orders"


def atac_cells(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(k.alias("cell_id"), (F.col("o_totalprice") / 40000).alias("TSSEnrichment"), F.when(k % 11 != 0, (k % 100) / 200.0).alias("FRIP"), F.col("o_totalprice").alias("nFrags"))
    return atac.check_cells(columns.rename_atac(o))


PASSING = f"c AS ({ATAC_CELLS}), ok AS (SELECT cell_id FROM c WHERE tss_enrichment >= 4 AND frip >= 0.15 AND n_fragments >= 3000)"


@query(f"WITH c AS ({ATAC_CELLS}) SELECT cell_id, coalesce(tss_enrichment >= 4 AND frip >= 0.15 AND n_fragments >= 3000, false) AS qc_pass FROM c")
def atac_cell_qc(spark, sf):
    return atac_cells(spark, sf).select("cell_id", "qc_pass")


def peaks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("cell_id"), (F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("peak_id"), F.col("l_quantity").alias("value"))


OPEN = f"{PASSING}, o AS (SELECT l_suppkey * 10 + l_linenumber AS peak_id, sum(l_quantity) AS openness FROM lineitem WHERE l_orderkey IN (SELECT cell_id FROM ok) GROUP BY 1)"


@query(f"WITH {OPEN} SELECT peak_id, round(openness, 6) AS openness FROM o")
def atac_peak_openness(spark, sf):
    return atac.peak_openness(peaks(spark, sf), atac_cells(spark, sf)).select("peak_id", r6("openness"))


@query("WITH l AS (SELECT 'G' || l_partkey AS gene, l_quantity - 25 AS d, coalesce(l_discount, 0) AS w FROM lineitem WHERE l_linenumber <> 4), a AS (SELECT gene, count(*) AS n_peaks, avg(d) AS mean_distance, median(d) AS median_distance, avg(abs(d)) AS mean_abs_distance, avg(abs(d)) AS composite_score, CASE WHEN sum(w) > 0 THEN sum(w * abs(d)) / sum(w) ELSE avg(abs(d)) END AS weighted_composite_score, sum(w) AS openness_sum_qc FROM l GROUP BY 1 HAVING count(*) >= 3) SELECT gene, n_peaks, round(mean_distance, 6) AS mean_distance, median_distance, round(mean_abs_distance, 6) AS mean_abs_distance, round(composite_score, 6) AS composite_score, round(weighted_composite_score, 6) AS weighted_composite_score, round(openness_sum_qc, 6) AS openness_sum_qc, row_number() OVER (ORDER BY round(composite_score, 6), n_peaks DESC, gene) AS rank FROM a")
def atac_gene_scores(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("d", F.when(F.col("l_linenumber") != 4, F.col("l_quantity") - 25)).withColumn("gene", F.concat(F.lit("G"), F.col("l_partkey").cast("string")))
    s = atac.gene_scores(atac.links(li, "gene", "d", "l_discount", "l_orderkey"), min_peaks=3)
    return s.select("gene", "n_peaks", r6("mean_distance"), "median_distance", r6("mean_abs_distance"), r6("composite_score"), r6("weighted_composite_score"), r6("openness_sum_qc"), "rank")


def predictions(spark: SparkSession, sf: str, genes_: int = 64, samples: int | None = None) -> DataFrame:
    e = table(spark, sf, "embeddings").where(F.col("vec_id") % 2 == 0) if samples is None else table(spark, sf, "embeddings").where((F.col("vec_id") % 2 == 0) & (F.col("vec_id") < samples))
    o = table(spark, sf, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    z = F.slice(F.arrays_zip(F.col("embedding").alias("y"), F.col("other").alias("f")), 1, genes_)
    return e.join(o, "vec_id").select(F.col("vec_id").alias("sample_id"), F.posexplode(z).alias("gene_idx", "z")).select("sample_id", "gene_idx", F.col("z.y").cast("double").alias("y"), F.col("z.f").cast("double").alias("f"))


def _pairs(genes_: int = 64, samples: int | None = None) -> str:
    cut = f" AND a.vec_id < {samples}" if samples else ""
    return f"p AS (SELECT a.vec_id AS sample_id, unnest(range(0, {genes_})) AS gene_idx, CAST(unnest(a.embedding[1:{genes_}]) AS DOUBLE) AS y, CAST(unnest(b.embedding[1:{genes_}]) AS DOUBLE) AS f FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id WHERE a.vec_id % 2 = 0{cut})"


@query(f"WITH {_pairs()}, g AS (SELECT sum((y - f) * (y - f)) AS res, sum(y * y) - sum(y) * sum(y) / count(*) AS tot FROM p GROUP BY gene_idx) SELECT round(avg((y - f) * (y - f)), 6) AS mse, round(sqrt(avg((y - f) * (y - f))), 6) AS rmse, round(avg(abs(y - f)), 6) AS mae, (SELECT round(avg(1 - res / tot), 6) FROM g) AS r2 FROM p")
def metric_mse_rmse_mae_r2(spark, sf):
    p = predictions(spark, sf)
    return metrics.errors(p).crossJoin(metrics.r2(p)).select(*(r6(c) for c in ("mse", "rmse", "mae", "r2")))


@query(f"WITH {_pairs()} SELECT sample_id, round(avg((y - f) * (y - f)), 6) AS mse, round(avg(abs(y - f)), 6) AS mae FROM p GROUP BY 1")
def metric_errors_by_sample(spark, sf):
    return metrics.errors(predictions(spark, sf), "sample_id").select("sample_id", r6("mse"), r6("mae"))


@query(f"WITH {_pairs()}, c AS (SELECT corr(y, f) AS r FROM p GROUP BY sample_id) SELECT round(avg(r), 6) AS pearson FROM c")
def metric_pearson(spark, sf):
    return metrics.pearson(predictions(spark, sf)).select(r6("pearson"))


@query(f"WITH {_pairs()}, k AS (SELECT sample_id, rank() OVER (PARTITION BY sample_id ORDER BY round(y, 1)) + (count(*) OVER (PARTITION BY sample_id, round(y, 1)) - 1) / 2.0 AS a, rank() OVER (PARTITION BY sample_id ORDER BY round(f, 1)) + (count(*) OVER (PARTITION BY sample_id, round(f, 1)) - 1) / 2.0 AS b FROM p), c AS (SELECT corr(CAST(a AS DOUBLE), CAST(b AS DOUBLE)) AS r FROM k GROUP BY sample_id) SELECT round(avg(r), 6) AS spearman FROM c")
def metric_spearman(spark, sf):
    p = predictions(spark, sf).withColumns({"y": F.round("y", 1), "f": F.round("f", 1)})
    return metrics.spearman(p).select(r6("spearman"))


@query(f"WITH {_pairs()}, r AS (SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY y, gene_idx) AS yl, row_number() OVER (PARTITION BY sample_id ORDER BY f, gene_idx) AS fl, row_number() OVER (PARTITION BY sample_id ORDER BY y DESC, gene_idx DESC) AS yh, row_number() OVER (PARTITION BY sample_id ORDER BY f DESC, gene_idx DESC) AS fh FROM p), s AS (SELECT count(*) FILTER (yl <= 20 AND fl <= 10) / 10.0 AS neg, count(*) FILTER (yh <= 20 AND fh <= 10) / 10.0 AS pos FROM r GROUP BY sample_id) SELECT round(CAST(avg(neg) AS DOUBLE), 6) AS precision_neg, round(CAST(avg(pos) AS DOUBLE), 6) AS precision_pos FROM s")
def metric_precision_k(spark, sf):
    return metrics.precision_at_k(predictions(spark, sf), 10, 20).select(r6("precision_neg"), r6("precision_pos"))


@query(f"WITH {_pairs()}, v AS (SELECT gene_idx, y AS v, 0 AS s FROM p UNION ALL SELECT gene_idx, f, 1 FROM p), k AS (SELECT a.gene_idx, sum(exp(-power(a.v - b.v, 2)) * CASE WHEN a.s = b.s THEN 1 ELSE -1 END) AS s FROM v a JOIN v b ON a.gene_idx = b.gene_idx GROUP BY 1), n AS (SELECT gene_idx, count(*) AS n FROM p GROUP BY 1) SELECT round(avg(s / n / n), 6) AS mmd FROM k JOIN n USING (gene_idx)")
def metric_mmd(spark, sf):
    return metrics.mmd(predictions(spark, sf)).select(r6("mmd"))


@query(f"WITH {_pairs()}, a AS (SELECT gene_idx, y, row_number() OVER (PARTITION BY gene_idx ORDER BY y) AS r FROM p), b AS (SELECT gene_idx, f, row_number() OVER (PARTITION BY gene_idx ORDER BY f) AS r FROM p), w AS (SELECT avg(abs(y - f)) AS w FROM a JOIN b USING (gene_idx, r) GROUP BY gene_idx) SELECT round(avg(w), 6) AS wasserstein FROM w")
def metric_wasserstein(spark, sf):
    return metrics.wasserstein(predictions(spark, sf)).select(r6("wasserstein"))


def kg_nodes(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for i, (prefix, kind, key, name) in enumerate([("region", "Region", "r_regionkey", "r_name"), ("nation", "Nation", "n_nationkey", "n_name"), ("customer", "Customer", "c_custkey", "c_name"), ("supplier", "Supplier", "s_suppkey", "s_name"), ("part", "Part", "p_partkey", "p_name")]):
        one = table(spark, sf, prefix).select(F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string")).alias("id"), F.col(name).alias("name"), F.lit(kind).alias("type"), F.when(F.col(key) % 2 == 0, "told").otherwise("").alias("desc"), (F.col(key).cast("long") + F.lit(i).cast("long") * 1_000_000_000).alias("pos"))
        out = one if out is None else out.unionByName(one)
    return out


NODES = "nodes AS (" + " UNION ALL ".join(f"SELECT '{p}:' || {k} AS id, {n} AS name, '{p.title()}' AS type, CASE WHEN {k} % 2 = 0 THEN 'told' ELSE '' END AS descr, CAST({k} AS BIGINT) + {i} * CAST(1000000000 AS BIGINT) AS pos FROM {p}" for i, (p, k, n) in enumerate([("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name")])) + ")"


def kg_base_edges(spark: SparkSession, sf: str) -> DataFrame:
    edge = lambda df, a, x, b, y, kind: df.select(F.concat(F.lit(f"{a}:"), F.col(x).cast("string")).alias("src"), F.concat(F.lit(f"{b}:"), F.col(y).cast("string")).alias("dst"), F.lit(kind).alias("type"))
    t = lambda n: table(spark, sf, n)
    sold = t("lineitem").select("l_partkey", "l_suppkey")
    sold = graph.dealt(sold, sold.count(), "l_partkey", "l_suppkey").distinct()
    out = edge(t("nation"), "nation", "n_nationkey", "region", "n_regionkey", "Nation-Region")
    for more in (edge(t("customer"), "customer", "c_custkey", "nation", "c_nationkey", "Customer-Nation"), edge(t("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey", "Supplier-Nation"), edge(sold, "part", "l_partkey", "supplier", "l_suppkey", "Part-Supplier")):
        out = out.unionByName(more)
    return out


def kg_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.both_ways(graph.allowed_edges(kg_base_edges(spark, sf)), ["Nation-Region", "Supplier-Nation", "Part-Supplier"])


EDGES = "base AS (SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'Nation-Region' AS type FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'Customer-Nation' FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'Supplier-Nation' FROM supplier UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'Part-Supplier' FROM lineitem), edges AS (SELECT * FROM base UNION ALL SELECT dst, src, split_part(type, '-', 2) || '-' || split_part(type, '-', 1) FROM base WHERE type <> 'Customer-Nation')"


@query(f"WITH {EDGES} SELECT src, dst, type FROM edges")
def kg_edges_bidirectional(spark, sf):
    return kg_edges(spark, sf)


@query(f"WITH {EDGES} SELECT src, dst, type FROM base WHERE type <> 'Part-Supplier' UNION ALL SELECT dst, src, 'rev_' || type FROM base WHERE type <> 'Part-Supplier'")
def kg_edges_prefixed(spark, sf):
    return graph.both_ways(graph.allowed_edges(kg_base_edges(spark, sf), ["Nation-Region", "Customer-Nation", "Supplier-Nation"]), None, "rev_")


@query(f"WITH {NODES} SELECT id, type FROM nodes")
def kg_entity_types(spark, sf):
    return kg_nodes(spark, sf).select("id", graph.entity_type(F.col("id"), {"region": "Region"}).alias("type"))


def seed_list(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.upper("n_name").alias("seed"))
    c = table(spark, sf, "customer").select(F.right("c_name", F.lit(4)).alias("seed"))
    return n.unionByName(c).unionByName(spark.range(1).select(F.lit("no such thing").alias("seed"))).distinct()


SEEDS = "seeds AS (SELECT upper(n_name) AS seed FROM nation UNION SELECT right(c_name, 4) FROM customer UNION SELECT 'no such thing')"


@query(f"WITH {NODES}, {SEEDS}, ex AS (SELECT seed, id, type, pos FROM seeds JOIN nodes ON lower(name) = lower(seed)), rest AS (SELECT seed FROM seeds WHERE seed NOT IN (SELECT seed FROM ex)), part_ AS (SELECT seed, id, type, pos, lower(name) AS low FROM rest JOIN nodes ON contains(lower(name), lower(seed))), f AS (SELECT seed, arg_min(low, pos) AS low FROM part_ GROUP BY 1), cand AS (SELECT * FROM ex UNION ALL SELECT p.seed, id, type, pos FROM part_ p JOIN f USING (seed, low)), b AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY CASE type WHEN 'Supplier' THEN 0 WHEN 'Customer' THEN 1 ELSE 2 END, pos) AS n FROM cand) SELECT seed, id, type, CASE WHEN id IS NULL THEN 'not found' ELSE 'ok' END AS status FROM seeds LEFT JOIN (SELECT * FROM b WHERE n = 1) USING (seed)")
def kg_resolve_seed(spark, sf):
    return graph.resolve_seeds(seed_list(spark, sf), kg_nodes(spark, sf), ["Supplier", "Customer"]).select("seed", "id", "type", "status")


@query(f"WITH {NODES}, {SEEDS}, named AS (SELECT id, type, pos, lower(name) AS low FROM nodes UNION SELECT id, type, pos, id FROM nodes UNION SELECT id, type, pos, split_part(id, ':', 2) FROM nodes), ex AS (SELECT seed, id, type, pos, 0 AS rk, 0 AS sz FROM seeds JOIN named ON low = lower(seed)), rest AS (SELECT seed FROM seeds WHERE seed NOT IN (SELECT seed FROM ex)), p AS (SELECT seed, id, type, pos, CASE WHEN contains(' ' || low || ' ', ' ' || lower(seed) || ' ') THEN 1 WHEN starts_with(low, lower(seed)) THEN 2 ELSE 3 END AS rk, length(low) AS sz FROM rest JOIN named ON contains(low, lower(seed))), cand AS (SELECT * FROM ex UNION ALL SELECT * FROM p), b AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY CASE type WHEN 'Part' THEN 0 WHEN 'Customer' THEN 1 ELSE 2 END, rk, sz, pos, id) AS n FROM cand) SELECT seed, id, type, CASE WHEN id IS NULL THEN 'not found' ELSE 'ok' END AS status FROM seeds LEFT JOIN (SELECT * FROM b WHERE n = 1) USING (seed)")
def kg_resolve_fuzzy(spark, sf):
    return graph.resolve_seeds(seed_list(spark, sf), kg_nodes(spark, sf), ["Part", "Customer"], fuzzy_rank=True).select("seed", "id", "type", "status")


CAPS = {"Region": 1, "Nation": 4, "Customer": 5, "Supplier": 6, "Part": 5, "*": 2}
BONUS = {"Supplier": 2.5, "Part": 1.8, "Nation": 1.2, "Customer": 0.6}
EDGE_BONUS = {"Nation-Supplier": 1.5, "Supplier-Part": 0.3}


def kg_seeds(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("seed"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("seed"))
    return n.unionByName(s).withColumn("id", F.col("seed"))


def subgraph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return graph.expand(kg_seeds(spark, sf), kg_nodes(spark, sf), staged(kg_edges(spark, sf), "edges"), 2, 14, CAPS, BONUS, EDGE_BONUS)


def _case(col: str, values: dict, default: float) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items() if k != "*") + f" ELSE {default} END"


def _hop(h: int, last: int = 2, most: int = 14) -> str:
    cap = _case("type", CAPS, CAPS["*"])
    return f"""m{h} AS (SELECT k.seed, k.id AS src, k.ord AS f, e.dst, e.type AS et FROM k{h - 1} k JOIN edges e ON e.src = k.id JOIN (SELECT seed, count(*) AS nn FROM k{h - 1} GROUP BY 1) t ON t.seed = k.seed AND nn < {most} WHERE k.hop = {h - 1}),
old{h} AS (SELECT m.seed, src, m.dst, et, {h} AS hop, 0 AS grp, 0 AS s, f FROM m{h} m WHERE EXISTS (SELECT 1 FROM k{h - 1} k WHERE k.seed = m.seed AND k.id = m.dst)),
new{h} AS (SELECT m.*, n.name, n.type, n.descr, coalesce(c.n, 0) AS n_type, round({_case('n.type', BONUS, 0.4)} + {_case('et', EDGE_BONUS, 0.0)} + CASE WHEN n.descr <> '' THEN 0.8 ELSE 0 END + greatest(0, 1.8 - 0.35 * coalesce(c.n, 0)), 9) AS score FROM m{h} m JOIN nodes n ON n.id = m.dst LEFT JOIN (SELECT seed, type, count(*) AS n FROM k{h - 1} GROUP BY 1, 2) c ON c.seed = m.seed AND c.type = n.type WHERE NOT EXISTS (SELECT 1 FROM k{h - 1} k WHERE k.seed = m.seed AND k.id = m.dst)),
one{h} AS (SELECT seed, dst AS id, type, max(score) AS score, min(f) AS mf, any_value(n_type) AS n_type FROM new{h} GROUP BY seed, dst, type),
rk{h} AS (SELECT *, row_number() OVER (PARTITION BY seed, type ORDER BY score DESC, mf, id) AS r, {cap} - n_type AS room FROM one{h}),
tm{h} AS (SELECT seed, type, row_number() OVER (PARTITION BY seed, type ORDER BY mf, id) AS n, mf AS tf, id AS ti FROM one{h}),
ok{h} AS (SELECT rk{h}.*, tf, ti FROM rk{h} JOIN tm{h} USING (seed, type) WHERE n = 1 AND room > 0 AND r <= least(room, greatest(1, ceil(room / {last - h + 1}.0)))),
pk{h} AS (SELECT * FROM (SELECT ok.*, row_number() OVER (PARTITION BY seed ORDER BY CASE WHEN r = 1 THEN 0 ELSE 1 END, CASE WHEN r = 1 THEN n_type END, CASE WHEN r = 1 THEN -({_case('type', BONUS, 0.0)}) END, CASE WHEN r = 1 THEN tf END, CASE WHEN r = 1 THEN ti END, score DESC, mf, id) AS s FROM ok{h} ok) q WHERE s <= {most} - (SELECT count(*) FROM k{h - 1} k WHERE k.seed = q.seed)),
k{h} AS (SELECT * FROM k{h - 1} UNION ALL SELECT seed, id, type, {h} AS hop, s AS ord FROM pk{h})"""


GRAPH = f"{NODES}, {EDGES}, k0 AS (SELECT seed, seed AS id, n.type, 0 AS hop, 1 AS ord FROM (SELECT 'nation:' || n_nationkey AS seed FROM nation UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier) JOIN nodes n ON n.id = seed), {_hop(1)}, {_hop(2)}, kn AS (SELECT seed, id, type, hop, row_number() OVER (PARTITION BY seed ORDER BY hop, ord) AS ord FROM k2), rec AS (SELECT * FROM old1 UNION ALL SELECT m.seed, src, m.dst, et, 1, 1, p.s, f FROM m1 m JOIN pk1 p ON p.seed = m.seed AND p.id = m.dst UNION ALL SELECT * FROM old2 UNION ALL SELECT m.seed, src, m.dst, et, 2, 1, p.s, f FROM m2 m JOIN pk2 p ON p.seed = m.seed AND p.id = m.dst), ke AS (SELECT seed, src, dst, et AS type, hop, row_number() OVER (PARTITION BY seed ORDER BY hop, grp, s, f, dst, src, et) AS ord FROM (SELECT *, row_number() OVER (PARTITION BY seed, src, dst, et ORDER BY hop, grp, s, f) AS n FROM rec) WHERE n = 1)"


@query(f"WITH {GRAPH} SELECT seed, id, type, CAST(hop AS BIGINT) AS hop, ord FROM kn")
def kg_hop_select(spark, sf):
    return subgraph(spark, sf)[0].select("seed", "id", "type", big("hop"), big("ord"))


@query(f"WITH {GRAPH} SELECT seed, src, dst, type, CAST(hop AS BIGINT) AS hop, ord FROM ke")
def kg_subgraph(spark, sf):
    return subgraph(spark, sf)[1].select("seed", "src", "dst", "type", big("hop"), big("ord"))


@query(f"WITH {GRAPH} SELECT seed, dst AS id, round(CAST(max(score) AS DOUBLE), 6) AS score FROM new1 GROUP BY 1, 2")
def kg_candidate_scores(spark, sf):
    nodes = kg_nodes(spark, sf)
    n = table(spark, sf, "lineitem").count() + nodes.count()
    return graph.candidates(kg_seeds(spark, sf), nodes, kg_edges(spark, sf), n, BONUS, EDGE_BONUS).select("seed", "id", r6("score"))


@query(f"WITH {GRAPH}, nl AS (SELECT kn.seed, string_agg(n.name || ' [' || n.type || CASE WHEN n.descr <> '' THEN ' | ' || n.descr ELSE '' END || ']', chr(10) ORDER BY ord) AS t, count(*) AS node_count FROM kn JOIN nodes n USING (id) GROUP BY 1), el AS (SELECT ke.seed, string_agg(a.name || ' -> ' || b.name || ' (' || ke.type || ')', chr(10) ORDER BY ord) AS t, count(*) AS edge_count FROM ke JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst GROUP BY 1) SELECT seed, node_count, coalesce(edge_count, 0) AS edge_count, '<|HVG_subgraph|>' || chr(10) || 'NODES:' || chr(10) || nl.t || chr(10) || chr(10) || 'EDGES:' || coalesce(chr(10) || el.t, '') AS structured_text FROM nl LEFT JOIN el USING (seed)")
def kg_render_text(spark, sf):
    return graph.render(*subgraph(spark, sf))


@query(f"WITH {GRAPH} SELECT seed, count(*) FILTER (id LIKE 'customer:%' AND CAST(split_part(id, ':', 2) AS INT) IN (SELECT vec_id FROM embeddings)) AS found, count(*) FILTER (NOT (id LIKE 'customer:%' AND CAST(split_part(id, ':', 2) AS INT) IN (SELECT vec_id FROM embeddings))) AS missing FROM kn GROUP BY 1")
def kg_embedding_attach(spark, sf):
    e = table(spark, sf, "embeddings").select(F.concat(F.lit("customer:"), F.col("vec_id").cast("string")).alias("id"), F.col("embedding").alias("vec"))
    return graph.attach_embeddings(subgraph(spark, sf)[0], e)[1]


@query(f"WITH {EDGES}, d AS (SELECT src, dst, type, count(*) OVER (PARTITION BY src) AS degree FROM edges) SELECT src, degree, CAST(CAST('0x' || substr(md5(dst), 1, 8) AS BIGINT) % CAST(ceil(degree / 20.0) AS BIGINT) AS BIGINT) AS part, string_agg(dst || ' ' || type, ',' ORDER BY dst, type) AS neighbours FROM d GROUP BY ALL")
def kg_adjacency(spark, sf):
    a = graph.adjacency(kg_edges(spark, sf), 20)
    return a.select("src", "degree", "part", F.array_join(F.transform("neighbours", lambda x: F.concat_ws(" ", x["dst"], x["type"])), ",").alias("neighbours"))


def token_table(spark: SparkSession, sf: str) -> DataFrame:
    top = expression.top_genes(expr(spark, sf), 4, 32).withColumn("token", F.col("gene_idx") + 1)
    return expression.token_rows(top, 4, "token")


@query(f"WITH {TOP}, t AS (SELECT cell_id, gene_idx + 1 AS token, rank - 1 AS i FROM binned WHERE rank > 1) SELECT cell_id, i, token FROM t WHERE ((((cell_id * 4099 + i) * 1103515245 + 42 * 12345) % 2147483647) * 48271) % 2147483647 < 1073741823")
def mask_positions(spark, sf):
    rows = token_table(spark, sf)
    mask = sequences.mask_positions(F.col("gene_ids"), F.col("cell_id"), 0.5)
    hit = rows.select("cell_id", F.posexplode(F.arrays_zip(F.col("gene_ids").alias("t"), mask.alias("m"))).alias("i", "z")).where("z.m")
    return hit.select("cell_id", big("i"), F.col("z.t").cast("long").alias("token"))


@query(f"WITH {TOP}, l AS (SELECT cell_id, count(*) AS n FROM binned GROUP BY 1) SELECT cell_id, CAST(-10000 * (4 - n) AS DOUBLE) AS total FROM l")
def attention_mask(spark, sf):
    rows = token_table(spark, sf)
    return rows.select("cell_id", F.aggregate(sequences.attention_mask(F.col("gene_ids")), F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("WITH e AS (SELECT label, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS x FROM embeddings) SELECT CAST(label AS BIGINT) AS label, CAST(i AS BIGINT) AS i, round(avg(CAST(x AS DOUBLE)), 6) AS x FROM e GROUP BY ALL")
def token_pooling(spark, sf):
    parts = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x")).select(big("label"), big("i"), r6("x"))


@query(f"WITH {METRICS} SELECT cell_id, n_genes, n_counts FROM m WHERE n_genes >= 2 AND n_genes <= 6 AND n_counts >= 40 AND n_counts <= 200 AND pct_mt < 50")
def cell_qc_strict(spark, sf):
    kept = expression.filter_cells(with_metrics(spark, sf), min_genes=2, max_genes=6, min_counts=40, max_counts=200, max_pct_mt=50, strict_mt=True)
    return kept.select("cell_id", big("n_genes"), "n_counts")


@query(f"WITH {OPEN} SELECT l_orderkey * 10 + l_linenumber AS link, round(coalesce(openness, 0), 6) AS openness FROM lineitem LEFT JOIN o ON peak_id = l_suppkey * 10 + l_linenumber")
def atac_link_openness(spark, sf):
    li = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("link"), (F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("source_index"), F.lit(None).cast("double").alias("openness"))
    return atac.with_openness(li, atac.peak_openness(peaks(spark, sf), atac_cells(spark, sf))).select(big("link"), r6("openness"))


@query("SELECT c_custkey, c_mktsegment AS tissue, CAST(c_nationkey AS VARCHAR) AS disease, c_mktsegment = 'BUILDING' AS qc_pass, c_mktsegment || '|none|none|none|none|none|none|none|none|none|none|none|' || c_nationkey || '|none|none|none' AS texts FROM customer")
def meta_standard(spark, sf):
    c = columns.qc_flag(columns.standardize(table(spark, sf, "customer"), {"tissue": "C-MktSegment", "disease": "c nationkey"}), "C_MKTSEGMENT", "BUILDING")
    return c.select("c_custkey", "tissue", "disease", "qc_pass", F.array_join(columns.text_columns(c), "|").alias("texts"))


@query("SELECT o_orderkey, CAST(NULL AS DOUBLE) AS n_genes, o_totalprice AS n_counts, CAST(NULL AS DOUBLE) AS pct_mt FROM orders")
def meta_metrics(spark, sf):
    o = columns.detect_metrics(table(spark, sf, "orders").withColumnRenamed("o_totalprice", "Total_Counts"))
    return o.select("o_orderkey", "n_genes", "n_counts", "pct_mt")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders")
def row_numbers(spark, sf):
    return columns.number_rows(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", F.floor(F.col("o_orderkey") / 1000), "pos")


@query(f"WITH {EDGES} SELECT type, n_edges, n_nodes FROM (SELECT type, count(*) AS n_edges FROM edges GROUP BY 1) JOIN (SELECT type, count(DISTINCT id) AS n_nodes FROM (SELECT type, src AS id FROM edges UNION ALL SELECT type, dst FROM edges) GROUP BY 1) USING (type)")
def kg_type_counts(spark, sf):
    return graph.counts(kg_edges(spark, sf))


@query(f"WITH {TOP}, t AS (SELECT cell_id, gene_idx + 1 AS token, rank - 1 AS i FROM binned) SELECT cell_id, CAST(sum(CASE WHEN i > 0 AND ((((cell_id * 4099 + i) * 1103515245 + 42 * 12345) % 2147483647) * 48271) % 2147483647 < 1073741823 THEN -1 ELSE token END) AS BIGINT) AS total FROM t GROUP BY 1")
def mask_apply(spark, sf):
    rows = token_table(spark, sf)
    hidden = sequences.masked(F.col("gene_ids"), sequences.mask_positions(F.col("gene_ids"), F.col("cell_id"), 0.5), -1)
    return rows.select("cell_id", F.aggregate(hidden, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"WITH {_pairs()}, g AS (SELECT sum((y - f) * (y - f)) AS res, sum(y * y) - sum(y) * sum(y) / count(*) AS tot FROM p GROUP BY gene_idx), c AS (SELECT corr(y, f) AS r FROM p GROUP BY sample_id) SELECT round_even(avg((y - f) * (y - f)), 3) AS mse, round_even(sqrt(avg((y - f) * (y - f))), 3) AS rmse, round_even(avg(abs(y - f)), 3) AS mae, (SELECT round_even(avg(1 - res / tot), 3) FROM g) AS r2, (SELECT round_even(avg(r), 3) FROM c) AS pearson FROM p")
def metric_bundle(spark, sf):
    return metrics.bundle(predictions(spark, sf)).select("mse", "rmse", "mae", "r2", "pearson")


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE l_linenumber = 5 OR l_quantity >= 20")
def atac_supported_peaks(spark, sf):
    p = table(spark, sf, "lineitem").withColumn("ncells", F.when(F.col("l_linenumber") != 5, F.col("l_quantity")))
    return atac.supported(p, 20).select("l_orderkey", big("l_linenumber"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment WHEN n_name IS NOT NULL THEN n_name ELSE 'none' END AS drug FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <> 2")
def drug_fallback(spark, sf):
    c = table(spark, sf, "customer").withColumn("cmap", F.when(F.col("c_custkey") % 3 == 0, " NA ").otherwise(F.col("c_mktsegment")))
    out = columns.lookup(c, table(spark, sf, "nation").withColumn("c_nationkey", F.expr("CASE WHEN n_regionkey <> 2 THEN n_nationkey END")), "c_nationkey", "n_name", "pert")
    return out.select("c_custkey", columns.fallback(F.col("cmap"), F.col("pert")).alias("drug"))


@query("WITH e AS (SELECT vec_id, unnest(range(0, 8)) AS t, embedding FROM embeddings), s AS (SELECT vec_id, t, CAST(embedding[t * 8 + 1] AS DOUBLE) AS s, embedding FROM e), w AS (SELECT vec_id, t, exp(s) / sum(exp(s)) OVER (PARTITION BY vec_id) AS w, embedding FROM s), x AS (SELECT vec_id, t, w, unnest(range(0, 8)) AS i, embedding FROM w) SELECT vec_id, i, round(sum(w * CAST(embedding[t * 8 + i + 1] AS DOUBLE)), 6) AS x FROM x GROUP BY 1, 2")
def attention_pooling(spark, sf):
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("embedding", t * 8 + 1, F.lit(8)))
    e = table(spark, sf, "embeddings").withColumn("tokens", tokens)
    pooled = sequences.pool(F.col("tokens"), "attention", F.transform("tokens", lambda v: F.get(v, F.lit(0))))
    return e.select("vec_id", F.posexplode(pooled).alias("i", "x")).select("vec_id", big("i"), r6("x"))


@query("WITH r AS (SELECT vec_id AS cell_id, count(*) AS n_genes, round(sum(CAST(x AS DOUBLE)), 6) AS n_counts FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY 1) SELECT vec_id AS cell_id, coalesce(n_genes, 0) AS n_genes, coalesce(n_counts, 0) AS n_counts FROM embeddings LEFT JOIN r ON vec_id = cell_id")
def cell_qc_ragged(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("genes", F.sequence(F.lit(0), F.size("embedding") - 1)).withColumn("values", F.col("embedding").cast("array<double>"))
    long = expression.to_long(e, "vec_id", "values", "genes")
    c = e.select(F.col("vec_id").alias("cell_id"))
    return expression.cell_metrics(long, c, spark.range(0).select(F.col("id").alias("gene_idx")), count_zeros=True).select("cell_id", big("n_genes"), r6("n_counts"))


@query(f"WITH {EXPR}, t AS (SELECT cell_id, least(count(*), 4) AS n FROM expr JOIN part ON gene_idx = p_partkey WHERE value <> 0 AND p_size <= 16 GROUP BY 1) SELECT o_orderkey AS cell_id, coalesce(n, 0) AS length FROM orders LEFT JOIN t ON cell_id = o_orderkey")
def tok_keep_empty(spark, sf):
    """Cells none of whose genes has a token stay, as padding."""
    tokens = table(spark, sf, "part").select(F.col("p_partkey").alias("gene_idx"), F.when(F.col("p_size") <= 16, F.col("p_partkey") + 1).alias("token"))
    rows = expression.token_rows(expression.top_genes(expr(spark, sf), 4, 32, tokens=tokens), 4, "token", cells(spark, sf))
    return rows.select("cell_id", F.col("lengths").cast("long").alias("length"))


SEURAT = """WITH v AS (SELECT label, g AS gene_idx, exp(embedding[g + 1]) AS v FROM embeddings, range(64) AS r(g)),
stats AS (SELECT label, gene_idx, count(*)::DOUBLE AS n, sum(v) / count(*) AS mean, greatest((sum(v * v) - sum(v) * sum(v) / count(*)) / (count(*) - 1), 0) AS var FROM v GROUP BY ALL HAVING count(*) > 1),
points AS (SELECT label, gene_idx, log10(mean) AS x, log10(var) AS y, least(count(*) OVER (PARTITION BY label), greatest(3, ceil(0.3 * count(*) OVER (PARTITION BY label)))) AS k FROM stats WHERE mean > 0 AND var > 0),
near AS (SELECT a.label, a.gene_idx, b.x - a.x AS d, b.y, max(abs(b.x - a.x)) OVER (PARTITION BY a.label, a.gene_idx ORDER BY abs(b.x - a.x), b.x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reach, row_number() OVER (PARTITION BY a.label, a.gene_idx ORDER BY abs(b.x - a.x), b.x) AS r, a.k FROM points a JOIN points b ON a.label = b.label),
kept AS (SELECT *, max(reach) OVER (PARTITION BY label, gene_idx) AS far FROM near WHERE r <= k),
weighed AS (SELECT *, power(1 - power(abs(d) / far, 3), 3) AS w FROM kept),
sums AS (SELECT label, gene_idx, sum(w) AS a, sum(w * d) AS b, sum(w * d * d) AS c, sum(w * d * d * d) AS e, sum(w * d * d * d * d) AS f, sum(w * y) AS t, sum(w * d * y) AS u, sum(w * d * d * y) AS v FROM weighed GROUP BY ALL),
fitted AS (SELECT label, gene_idx, sqrt(power(10, (t * (c * f - e * e) - b * (u * f - e * v) + c * (u * e - c * v)) / (a * (c * f - e * e) - b * (b * f - e * c) + c * (b * e - c * c)))) AS spread FROM sums),
z AS (SELECT label, gene_idx, n, least((v.v - mean) / spread, sqrt(n)) AS z FROM v JOIN stats USING (label, gene_idx) JOIN fitted USING (label, gene_idx)),
scored AS (SELECT label, gene_idx, (sum(z * z) - sum(z) * sum(z) / any_value(n)) / (any_value(n) - 1) AS score FROM z GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, gene_idx) AS r FROM scored),
genes AS (SELECT gene_idx, count(*) FILTER (r <= 20) AS n_batches, median(r) FILTER (r <= 20) AS median_rank, avg(score) AS score FROM ranked GROUP BY 1)
SELECT gene_idx, n_batches, median_rank, round(score, 6) AS score, row_number() OVER (ORDER BY median_rank NULLS LAST, n_batches DESC, gene_idx) <= 20 AS is_hvg FROM genes"""


@query(SEURAT)
def hvg_seurat_style(spark, sf):
    long = expression.to_long(table(spark, sf, "embeddings"), "vec_id", "embedding").withColumn("value", F.exp("value"))
    c = table(spark, sf, "embeddings").select(F.col("vec_id").alias("cell_id"), "label")
    return expression.seurat_variable(long, c, "label", 20).select(big("gene_idx"), big("n_batches"), "median_rank", r6("score"), "is_hvg")


@query("SELECT name, round(CAST(quantile_cont(v, 0.1) AS DOUBLE), 6) AS low, round(CAST(quantile_cont(v, 0.5) AS DOUBLE), 6) AS median, round(CAST(quantile_cont(v, 0.9) AS DOUBLE), 6) AS high FROM (SELECT l_returnflag AS name, l_extendedprice AS v FROM lineitem) GROUP BY 1")
def order_quantiles(spark, sf):
    prices = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("name"), "l_extendedprice")
    return order.quantiles(prices, "l_extendedprice", {"low": 0.1, "median": 0.5, "high": 0.9}, "name").select("name", r6("low"), r6("median"), r6("high"))


@query("WITH d AS (SELECT l_returnflag, l_shipdate, CAST(sum(l_linenumber) AS BIGINT) AS amount FROM lineitem GROUP BY ALL) SELECT l_returnflag, CAST(l_shipdate AS VARCHAR) AS day, amount, CAST(sum(amount) OVER (PARTITION BY l_returnflag ORDER BY l_shipdate) AS BIGINT) AS total FROM d")
def order_running(spark, sf):
    days = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_shipdate").agg(F.sum("l_linenumber").alias("amount"))
    return order.running(days, "l_returnflag", ["l_shipdate"], "amount").select("l_returnflag", F.col("l_shipdate").cast("string").alias("day"), "amount", "total")


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS sample, o_orderpriority AS drug FROM orders WHERE o_orderstatus = 'F'")
def meta_observation_qc(spark, sf):
    o = columns.qc_flag(columns.standardize(table(spark, sf, "orders"), {"drug": "O OrderPriority"}), "o-orderstatus", "F")
    return o.where("qc_pass").select("o_orderkey", F.col("o_custkey").cast("string").alias("sample"), "drug")


@query("SELECT o_orderkey, c_mktsegment AS tissue, n_name AS drug FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'O'")
def meta_signature_qc(spark, sf):
    """Signatures with the cell line and the compound of their keys, those that pass."""
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    o = columns.enrich(o, table(spark, sf, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), "c_custkey", ["c_name"])
    o = columns.enrich(o, table(spark, sf, "nation"), "n_nationkey", ["n_name"])
    return columns.qc_flag(columns.standardize(o, {"tissue": "c_mktsegment", "drug": "n_name"}), "o_orderstatus", "O").where("qc_pass").select("o_orderkey", "tissue", "drug")


@query("SELECT c_custkey, c_mktsegment AS tissue, 'none' AS region, 'drug' AS \"perturbType\", CAST(c_nationkey AS VARCHAR) AS age, '' AS \"cellType1\" FROM customer")
def meta_literals(spark, sf):
    """What a set doesn't say is filled by its literals; what the map or the table says stays."""
    c = columns.with_literals(table(spark, sf, "customer"), datasets.SET_LITERALS, {"tissue": "c_mktsegment", "age": "c_nationkey"})
    return c.select("c_custkey", "tissue", "region", "perturbType", "age", "cellType1")


@query(f"WITH {TOP}, r AS (SELECT cell_id, string_agg(CAST(gene_idx AS VARCHAR), ',' ORDER BY rank) || repeat(',0', CAST(4 - count(*) AS INT)) AS gene_ids FROM binned GROUP BY 1) SELECT cell_id, gene_ids, '|none|none|none|none|none|none|none|none|none|none|none|none|' || o_orderpriority || '|none|none' AS texts FROM r JOIN (SELECT o_orderkey AS cell_id, o_orderpriority FROM orders) USING (cell_id)".replace("'|none|none", "'none|none|none", 1))
def tok_with_metadata(spark, sf):
    """Token rows with the text columns of their cells."""
    rows = expression.token_rows(expression.top_genes(expr(spark, sf), 4, 32), 4)
    meta = columns.standardize(table(spark, sf, "orders"), {"drug": "o_orderpriority"})
    texts = meta.select(F.col("o_orderkey").alias("cell_id"), F.array_join(columns.text_columns(meta), "|").alias("texts"))
    return rows.join(texts, "cell_id").select("cell_id", F.array_join("gene_ids", ",").alias("gene_ids"), "texts")


@query("SELECT p_partkey AS gene_idx, p_name AS gene_symbol FROM part WHERE starts_with(p_type, 'PROMO')")
def gene_mito(spark, sf):
    named = table(spark, sf, "part").select(F.col("p_partkey").alias("gene_idx"), F.col("p_name").alias("gene_symbol"), "p_type")
    return expression.mito_genes(named, "PROMO", "p_type").select("gene_idx", "gene_symbol")


@query(SQL["atac_gene_scores"] + " QUALIFY rank <= 50")
def atac_preview(spark, sf):
    """The best genes, as the preview beside the table of scores has them."""
    return atac.preview(atac_gene_scores(spark, sf), 50)


@query(f"WITH {NODES} SELECT type, count(*) AS n_nodes, CAST(CASE type " + " ".join(f"WHEN '{t}' THEN least(greatest(round_even(40 * {s}, 0), {a}), {b}, 40)" for t, (s, a, b) in {"Region": (0.10, 3, 12), "Part": (0.30, 10, 40), "Nation": (0.16, 4, 24), "*": (0.08, 2, 12)}.items() if t != "*") + " ELSE least(greatest(round_even(40 * 0.08, 0), 2), 12, 40) END AS BIGINT) AS cap FROM nodes GROUP BY 1")
def kg_type_caps(spark, sf):
    caps = graph.type_caps(40, {"Region": (0.10, 3, 12), "Part": (0.30, 10, 40), "Nation": (0.16, 4, 24), "*": (0.08, 2, 12)})
    cap = F.coalesce(*(F.when(F.col("type") == t, F.lit(n)) for t, n in caps.items() if t != "*"), F.lit(caps["*"]))
    return kg_nodes(spark, sf).groupBy("type").agg(F.count("*").alias("n_nodes")).select("type", "n_nodes", cap.cast("long").alias("cap"))


@query(f"WITH {EDGES} SELECT src, dst, type FROM base WHERE type IN ('Nation-Region', 'Part-Supplier')")
def kg_edges_of_types(spark, sf):
    """The union of some types' edges."""
    return graph.allowed_edges(kg_base_edges(spark, sf), ["Nation-Region", "Part-Supplier"])


@query(f"WITH {MAPPED} SELECT gene_idx AS gctx_gene_index, CAST(gene_idx AS VARCHAR) AS entrez_id, e AS ensembl_norm, s AS gene_symbol, hgnc_num, CAST(CASE WHEN hgnc_num <> '' THEN hgnc_num ELSE '0' END AS BIGINT) AS hgnctoken FROM mapped JOIN (SELECT gene_idx, e, s FROM g) USING (gene_idx)")
def gene_debug_table(spark, sf):
    info = table(spark, sf, "part").select(F.col("p_partkey").alias("gctx_index"), F.col("p_partkey").cast("string").alias("entrez_id"))
    mapped = genes.map_genes(gene_table(spark, sf), hgnc(spark, sf), "pos")
    told = mapped.select(F.col("gene_idx").cast("string").alias("entrez_id"), text.ensembl_id(F.col("ensembl_id")).alias("ensembl_norm"), "gene_symbol", "hgnc_num", F.coalesce(F.nullif(F.col("hgnc_num"), F.lit("")).cast("long"), F.lit(0)).alias("hgnc_token"))
    return datasets.gene_debug_table(info, told)


@query("WITH s AS (SELECT DISTINCT c_mktsegment AS k, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS v FROM customer) SELECT '{' || string_agg('\"' || k || '\":' || v, ',' ORDER BY k) || '}' AS value FROM s")
def json_object(spark, sf):
    """A map of labels and ids as one JSON object."""
    return sinks.json_object(columns.encode_sorted(table(spark, sf, "customer"), "c_mktsegment", "id").select("c_mktsegment", "id").distinct(), "c_mktsegment", "id")


@query("SELECT c_custkey, CAST(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS BIGINT) AS n FROM customer")
def list_or_empty(spark, sf):
    found = F.when(F.col("c_acctbal") > 0, F.array("c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", F.size(text.as_list(found)).cast("long").alias("n"))
