"""Cases computed by hand from the semantics."""

import pytest
from pyspark.sql import functions as F

from helixspark.functions import celltypes, sequences, text
from helixspark.operators import atac, columns, expression, genes, graph, metrics
from helixspark.streaming import ingest


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(("f", "value", "want"), [
    (text.ensembl_id, "ENSG00000001234.5", "ENSG00000001234"), (text.ensembl_id, " NA ", ""), (text.ensembl_id, "X.1", "X.1"), (text.ensembl_id, None, ""),
    (text.after_colon, "HGNC:5", "5"), (text.after_colon, "5", ""), (text.after_colon, "a:b:c", "b:c"),
    (celltypes.canonical, "NK", "Natural Killer Cell"), (celltypes.canonical, "T-cell", "T Cell"), (celltypes.canonical, "T_cell", "T Cell"), (celltypes.canonical, "weird__type", "weird type"), (celltypes.canonical, None, None), (celltypes.canonical, "", ""),
    (text.drug_doses, "[('Drug name', 0.05, 'uM')]", "0.05 uM"), (text.drug_doses, "plain", "plain"),
    (text.dose_um, "6.66 uM", 6.66), (text.dose_um, "100 nM", 0.1), (text.dose_um, "1 mM", 1000.0), (text.dose_um, "0.1 ng/ml", None), (text.dose_um, "10uM", None), (text.dose_um, "none", None), (text.dose_raw, "0.1 ng/ml", 0.1), (text.dose_raw, "1-2 uM", None), (text.dose_um, "1d uM", None),
    (text.hours, "24 h", 24.0), (text.hours, "72h", 72.0), (text.hours, "6", 6.0), (text.hours, "24 hours", None),
    (text.clean_description, "NCBI Gene: tumor protein p53 [Source:HGNC Symbol;Acc:HGNC:11998] | x", "tumor protein p53"), (text.clean_description, None, ""),
    (text.reversed_type, "A-B-C", "B-C-A"), (text.reversed_type, "AB", "rev_AB"), (text.safe, " NaN ", "none"), (text.safe, None, "none"),
])
def test_scalars(spark, f, value, want):
    got = one(spark, value, f)
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


@pytest.mark.parametrize(("n", "want"), [(5, [32, 26, 20, 13, 7]), (1, [32])])
def test_rank_bins(spark, n, want):
    df = spark.range(1, n + 1).select(sequences.rank_bin(F.col("id"), F.lit(n), 32).alias("b"))
    assert sorted((r.b for r in df.collect()), reverse=True) == want


def test_top_genes_with_tokens_and_empty_cells(spark):
    e = spark.createDataFrame([("c", 1, -5.0), ("c", 2, 3.0), ("c", 3, 0.0), ("c", 4, 4.0)], "cell_id string, gene_idx int, value double")
    tokens = spark.createDataFrame([(1, 11), (2, 12), (3, 13), (4, 0)], "gene_idx int, token int")
    top = expression.top_genes(e, 2, 32, use_abs=True, tokens=tokens)
    assert [(r.token, r.bin) for r in top.orderBy("rank").collect()] == [(11, 32), (12, 16)]
    cells = spark.createDataFrame([("c",), ("d",)], "cell_id string")
    rows = {r.cell_id: r for r in expression.token_rows(top, 3, "token", cells).collect()}
    assert rows["c"].gene_ids == [11, 12, 0] and rows["c"].bin_ids == [32, 16, 0] and rows["c"].lengths == 2
    assert rows["d"].gene_ids == [0, 0, 0] and rows["d"].lengths == 0


def test_cell_bounds(spark):
    c = spark.createDataFrame([("a", None, 5000.0, 20.0), ("b", 600.0, 5000.0, None), ("c", 600.0, 5000.0, 20.0)], "cell_id string, n_genes double, n_counts double, pct_mt double")
    keep = lambda **b: sorted(r.cell_id for r in expression.filter_cells(c, **b).collect())
    assert keep(min_genes=500) == ["b", "c"]
    assert keep(min_genes=0, max_genes=8000) == ["a", "b", "c"]
    assert keep(max_pct_mt=20) == ["a", "c"]
    assert keep(max_pct_mt=20, strict_mt=True) == []


def test_atac(spark):
    c = spark.createDataFrame([("a", 5.0, None, 4000.0, 0.01), ("b", 5.0, 0.2, 4000.0, 0.01)], "cell_id string, TSSEnrichment double, FRIP double, nFrags double, BlacklistRatio double")
    assert {r.cell_id: r.qc_pass for r in atac.check_cells(columns.rename_atac(c)).collect()} == {"a": False, "b": True}
    with pytest.raises(ValueError):
        atac.require_passing(atac.check_cells(columns.rename_atac(c.where("cell_id = 'a'"))))
    t = spark.createDataFrame([("A", -100.0, 1.0, 1), ("A", 300.0, 3.0, 2), ("B", 50.0, 0.0, 3), ("B", 150.0, 0.0, 4), (None, 1.0, 1.0, 5), ("C", None, 1.0, 6)], "g string, d double, o double, p long")
    s = {r.gene: r for r in atac.gene_scores(atac.links(t, "g", "d", "o", "p")).collect()}
    assert (s["A"].n_peaks, s["A"].mean_distance, s["A"].median_distance, s["A"].mean_abs_distance, s["A"].composite_score, s["A"].weighted_composite_score) == (2, 100, 100, 200, 200, 250)
    assert (s["B"].composite_score, s["B"].weighted_composite_score, s["B"].rank, s["A"].rank) == (100, 100, 1, 2) and set(s) == {"A", "B"}


def test_spearman_and_constant(spark):
    d = spark.createDataFrame([(0, i, float(y), float(f)) for i, (y, f) in enumerate(zip([1, 2, 2, 3], [1, 2, 3, 4], strict=True))], "sample_id int, gene_idx int, y double, f double")
    assert metrics.spearman(d).first()[0] == pytest.approx(0.948683, abs=1e-6)
    flat = d.withColumn("y", F.lit(1.0))
    assert metrics.pearson(flat).first()[0] is None
    row = metrics.bundle(d.withColumn("ctl", F.lit(0.5)), 1, 2, deltas=True).first().asDict()
    assert row["mse"] == row["mse_deg"] and set(row) >= {"rmse", "mae", "r2", "pearson", "spearman", "precision_neg", "precision_pos"}


def test_alias_overwrites_symbol(spark):
    h = spark.createDataFrame([(1, "HGNC:1", "X", None, None, "E1"), (2, "HGNC:2", "Y", "X", None, "E2")], "pos int, hgnc_id string, symbol string, alias_symbol string, prev_symbol string, ensembl_gene_id string")
    assert {r.name: r.hgnc_num for r in genes.aliases(h, "pos").collect()} == {"X": "2", "Y": "2"}


def test_type_caps():
    assert graph.type_caps(60) == {"Transcript": 6, "Protein": 18, "Drug": 10, "Disease": 8, "Pathway": 6, "Phenotype": 6, "Metabolite": 6, "Exposure": 4, "Gene": 7, "Microbiota": 4, "Promoter": 3, "*": 5}


def test_subgraph_text(spark):
    n = spark.createDataFrame([("gene:A", "A", "Gene", ""), ("p1", "P1", "Protein", ""), ("p2", "P2", "Protein", ""), ("p3", "P3", "Protein", ""), ("d1", "D1", "Drug", ""), ("d2", "D2", "Drug", "")], "id string, name string, type string, desc string")
    e = spark.createDataFrame([("gene:A", x, "Gene-Protein" if x[0] == "p" else "Gene-Drug") for x in ("p1", "p2", "p3", "d1", "d2")], "src string, dst string, type string")
    nodes, edges = graph.expand(spark.createDataFrame([("s", "gene:A")], "seed string, id string"), n, e, 1, 4)
    assert [r.name for r in nodes.orderBy("ord").collect()] == ["A", "D1", "P1", "D2"]
    assert [(r.src, r.dst) for r in edges.orderBy("ord").collect()] == [("gene:A", "d1"), ("gene:A", "p1"), ("gene:A", "d2")]
    out = graph.render(nodes, edges).first()
    assert out.structured_text.split("\n") == ["<|HVG_subgraph|>", "NODES:", "A [Gene]", "D1 [Drug]", "P1 [Protein]", "D2 [Drug]", "", "EDGES:", "A -> D1 (Gene-Drug)", "A -> P1 (Gene-Protein)", "A -> D2 (Gene-Drug)"]


def test_stratified_sample(spark):
    df = spark.range(300).select("id", (F.col("id") % 3).cast("string").alias("g"))
    got = expression.stratified_sample(df, "id", "g", 60)
    assert sorted(r["count"] for r in got.groupBy("g").count().collect()) == [20, 20, 20]
    with pytest.raises(ValueError):
        expression.stratified_sample(df, "id", "missing", 60)


def test_column_resolution():
    assert columns.resolve(["Cell_Type", "x"], "celltype") == "Cell_Type"
    assert columns.resolve(["a", "A"], "a") == "a" and columns.resolve(["B"], "b") == "B" and columns.resolve(["B"], "c") is None


def test_standard_columns(spark):
    df = columns.standardize(spark.createDataFrame([("nk", "lung", "1")], "Cell_Type string, organ string, ok string"), {"cellType1": "celltype", "tissue": "ORGAN", "drug": "absent"})
    row = columns.qc_flag(columns.detect_metrics(df), "OK", 1).first()
    assert (row.cellType1, row.tissue, row.drug, row.qc_pass, row.n_genes) == ("Natural Killer Cell", "lung", "", True, None)


def test_masks(spark):
    r = spark.createDataFrame([(7, list(range(1, 40)) + [0, 0])], "id long, t array<int>").select(sequences.mask_positions(F.col("t"), F.col("id"), 0.5).alias("m"), "t").first()
    assert not r.m[0] and not r.m[-1] and 5 < sum(r.m) < 34


def test_rows_of_arrays_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", [3, 1, 2], [1.0, -5.0, 0.0]), ("b", [], [])], "c string, g array<int>, v array<double>")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = ingest.start(stream, str(tmp_path / "out"), str(tmp_path / "state"), cell="c", genes="g", values="v", k=3, n_bins=32, use_abs=True)
    q.awaitTermination()
    got = {r.cell_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["a"].gene_ids == [1, 3, 0] and got["a"].bin_ids == [32, 16, 0] and got["b"].lengths == 0


def test_seurat_prefers_the_spread_gene(spark):
    import random

    rnd = random.Random(1)
    rows = [(c, g, 1.2 + g / 100 + rnd.choice([-1, 1]) * (1.1 if g == 5 else rnd.random() * 0.2)) for c in range(80) for g in range(30)]
    e = spark.createDataFrame(rows, "cell_id int, gene_idx int, value double")
    cells = spark.range(80).select(F.col("id").cast("int").alias("cell_id"), (F.col("id") % 2).cast("int").alias("b"))
    assert 5 in {r.gene_idx for r in expression.seurat_variable(e, cells, "b", 3).where("is_hvg").collect()}


def test_hashes_of_large_ids_do_not_overflow(spark):
    def rest(x, m):
        return x % m if x >= 0 else -(-x % m)

    def key(x, seed):
        return rest(rest(x * 1103515245 + seed * 12345, 2147483647) * 48271, 2147483647)

    ids = [0, 1, -1, -2, 9_000_000, 36_000_000, 2147483647, -2147483647, 2**62, -(2**62), 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(x,) for x in ids], "id long")
    for seed in (42, 0, 200_000):
        got = {r.id: (r.a, r.b) for r in df.select("id", text.shuffle_key(F.col("id"), seed).alias("a"), text.shuffle_key(F.col("id"), seed, 4099, F.lit(8200)).alias("b")).collect()}
        assert got == {x: (key(x, seed), key(x * 4099 + 8200, seed)) for x in ids}
    few = df.select("id", sequences.mask_positions(F.array(*(F.lit(5) for _ in range(6))), F.col("id"), 0.5).alias("m")).collect()
    assert {r.id: r.m for r in few} == {x: [i > 0 and key(x * 4099 + i, 42) < 1073741823 for i in range(6)] for x in ids}


def test_names_are_made_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(genes, "TASK_ROWS", 100, raising=False)
    told = spark.range(1000).coalesce(1).select(F.col("id").alias("pos"), F.concat(F.lit("HGNC:"), "id").alias("hgnc_id"), F.concat(F.lit("s"), "id").alias("symbol"), F.lit("a|b").alias("alias_symbol"), F.lit("old").alias("prev_symbol"), F.lit("").alias("ensembl_gene_id"))
    got = genes.aliases(told, "pos")
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    named = {r.name: r.hgnc_num for r in got.collect()}
    assert len(named) == 2006 and named["s7"] == named["S7"] == "7" and named["a"] == named["B"] == named["OLD"] == "999"
    mapped = genes.map_genes(spark.createDataFrame([("", "S5"), ("", "Old"), ("", "none")], "ensembl_id string, gene_symbol string"), told, "pos")
    assert mapped._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") >= 2 and sorted(r.hgnc_num for r in mapped.collect()) == ["", "5", "999"]
