import gzip
import json

import pytest
from pyspark.sql import functions as F

from helixspark.plans import pipelines
from helixspark.sources import sinks, tables


def test_matrix(spark, tmp_path):
    path = tmp_path / "m.mtx.gz"
    with gzip.open(path, "wt") as f:
        f.write("%%MatrixMarket matrix coordinate real general\n% note\n3 4 3\n1 1 2.5\n3 4 3\n2 2 1\n")
    assert tables.matrix_header(spark, str(path)) == (3, 4, 3)
    assert sorted(map(tuple, tables.read_matrix(spark, str(path)).collect())) == [(0, 0, 2.5), (1, 1, 1.0), (2, 3, 3.0)]


def test_delimiters_seeds_and_index(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x;y\n1;2\n")
    assert tables.read_table(spark, str(tmp_path / "a.txt")).first().asDict() == {"x": "1", "y": "2"}
    (tmp_path / "seeds").write_text(" TP53 \n\n#no\n #yes\n")
    assert [r.seed for r in tables.read_seeds(spark, str(tmp_path / "seeds")).collect()] == ["TP53", "#yes"]
    (tmp_path / "i.json").write_text('["a", "b"]')
    assert sorted(map(tuple, tables.read_entity_index(spark, str(tmp_path / "i.json")).collect())) == [("a", 0), ("b", 1)]
    (tmp_path / "j.json").write_text('{"a": 4}')
    assert sorted(map(tuple, tables.read_entity_index(spark, str(tmp_path / "j.json")).collect())) == [("a", 4)]


def test_edges_fall_back(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("a\tt\tb\n")
    assert tables.read_edges(spark, [str(tmp_path / "no.parquet"), str(tmp_path / "e.tsv")]).first().asDict() == {"src": "a", "dst": "b", "type": "t"}
    with pytest.raises(FileNotFoundError):
        tables.read_edges(spark, [str(tmp_path / "no.parquet")])
    with pytest.raises(ValueError):
        tables.require(spark.range(1), ["x"])


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, "6 uM", "24 h"), ("b", 1, "none", "x")], "cell_id string, shard_id int, dose string, time string")
    sinks.shards(rows, str(tmp_path / "s"))
    sinks.rewrite_shards(str(tmp_path / "s"), str(tmp_path / "t"), spark)
    got = {r.cell_id: (r.dose_um, r.time_h) for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert got == {"a": (6.0, 24.0), "b": (None, None)}
    base = sinks.intermediates(str(tmp_path), "v1", rows, rows, tables.Source("h5ad", "x"))
    assert json.loads(spark.read.text(f"{base}/data_source.json").first()[0])["format"] == "h5ad"


def test_pipeline(spark):
    expr = spark.range(200).select((F.col("id") % 20).cast("string").alias("cell_id"), (F.col("id") % 10).cast("int").alias("gene_idx"), (F.col("id") % 7 + 1).cast("double").alias("value"))
    cells = spark.range(21).select(F.col("id").cast("string").alias("cell_id"), F.lit("lung").alias("tissue"), (F.col("id") % 2).cast("string").alias("batch"))
    genes = spark.range(10).select(F.col("id").cast("int").alias("gene_idx"), F.concat(F.lit("S"), F.col("id").cast("string")).alias("gene_symbol"), F.lit("").alias("ensembl_id"))
    hgnc = spark.range(8).select(F.col("id").alias("pos"), F.concat(F.lit("HGNC:"), (F.col("id") + 1).cast("string")).alias("hgnc_id"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("symbol"), F.lit("").alias("alias_symbol"), F.lit("").alias("prev_symbol"), F.lit("").alias("ensembl_gene_id"))
    o = pipelines.TokenOptions(top_k=4, shard_size=6, n_hvg=6, bounds={"min_genes": 1}, domain="batch")
    rows, table, vocab = pipelines.tokenize(expr, cells, genes, hgnc, o, F.substring("cell_id", 1, 1))
    got = rows.collect()
    assert 0 < len(got) <= 20 and all(len(r.gene_ids) == 4 and sum(x > 0 for x in r.gene_ids) == r.lengths for r in got)
    assert max(r.shard_id for r in got) == (len(got) - 1) // 6 and {r.domain_id for r in got} <= {0, 1}
    assert all(r.text_data[0] == "lung" and r.text_data[1] == "none" for r in got)
    assert vocab.count() <= 6


def test_tokens_from_staged_cells_are_the_same(spark, tmp_path):
    cells = spark.createDataFrame([(f"c{i}", False) for i in range(6)], "cell_id string, predicted_doublet boolean")
    genes = spark.createDataFrame([(i, f"ENSG{i}", f"S{i}" if i else "mt-1") for i in range(6)], "gene_idx long, ensembl_id string, gene_symbol string")
    hgnc = spark.createDataFrame([(i, f"HGNC:{i + 1}", f"S{i}", "", "", f"ENSG{i}") for i in range(6)], "pos long, hgnc_id string, symbol string, alias_symbol string, prev_symbol string, ensembl_gene_id string")
    expr = spark.createDataFrame([(f"c{i}", g, float(1 + (i * g) % 5)) for i in range(6) for g in range(6)], "cell_id string, gene_idx long, value double")
    made = lambda **o: pipelines.tokenize(expr, cells, genes, hgnc, pipelines.TokenOptions(top_k=4, shard_size=4, n_hvg=6, sample=4, bounds={"max_pct_mt": 10}, mito="mt-", **o), F.substring("cell_id", 1, 1))
    plain, staged = made(), made(stage=str(tmp_path))
    for a, b in zip(plain, staged, strict=True):
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    assert {r.cell_id for r in plain[0].collect()} == {"c1", "c2", "c3", "c4"}  # mt- genes are a sixth of c0 and c5, less of the others
    assert len(list(tmp_path.iterdir())) == 1
