"""From a chromatin bundle's files to gene scores, and the sources and sinks beside them."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from helixspark.functions import sequences
from helixspark.operators import atac, graph
from helixspark.plans import pipelines
from helixspark.sources import sinks, tables


@pytest.fixture
def bundle(tmp_path):
    folder = tmp_path / "b"
    (folder / "peak_bc").mkdir(parents=True)
    (folder / "LSI_embedding").mkdir()
    (folder / "peak_bc/obs.csv").write_text("cell_barcode,TSSEnrichment,FRIP,nFrags,BlacklistRatio\nz,9,0.5,9000,0.01\na,9,0.5,9000,0.01\nm,1,0.5,9000,0.01\n")
    (folder / "peak_bc/var.csv").write_text("peak_index,nearestGene,distToTSS\n0,G1,100\n1,G1,-300\n2,G2,50\n3,,7\n")
    with gzip.open(folder / "peak_bc/counts.mtx.gz", "wt") as f:
        f.write("%%MatrixMarket matrix coordinate real general\n3 4 5\n1 1 1\n2 2 2\n2 1 1\n3 3 8\n3 4 5\n")
    return str(folder)


def test_bundle_to_scores(spark, bundle):
    from helixspark.operators.columns import rename_atac

    cells, peaks = tables.read_atac_bundle(spark, bundle)
    counts = tables.read_atac_counts(spark, bundle, cells)
    assert sorted(map(tuple, counts.collect())) == [("a", 0, 1.0), ("a", 1, 2.0), ("m", 2, 8.0), ("m", 3, 5.0), ("z", 0, 1.0)]
    link = atac.links(peaks, "nearestGene", "distToTSS", None, "peak_row")
    got = {r.gene: r for r in pipelines.gene_activity(counts, rename_atac(cells), link).collect()}
    # cell m fails; G1: openness 2 at 100 and 2 at -300
    assert got["G1"].openness_sum_qc == 4 and got["G1"].weighted_composite_score == 200 and got["G1"].n_peaks == 2
    assert got["G2"].openness_sum_qc == 0 and got["G2"].weighted_composite_score == 50 and got["G2"].rank == 1 and set(got) == {"G1", "G2"}


def test_bundle_is_inspected(spark, bundle):
    got = tables.inspect_atac_bundle(spark, bundle)
    assert set(got["parts"]) == {"peak_bc", "LSI_embedding"} and got["parts"]["peak_bc"]["shape"] == (3, 4, 5)
    assert got["parts"]["peak_bc"]["obs"]["n_rows"] == 3 and got["parts"]["LSI_embedding"] == {"shape": None}
    assert (got["gene_column"], got["distance_column"]) == ("nearestGene", "distToTSS")
    with pytest.raises(FileNotFoundError):
        tables.inspect_atac_bundle(spark, bundle + "x")


def test_flat_table(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("gene\tdistance\tscore\nB\t10\t1.5\n\t20\t2\nA\tx\t3\n")
    rows = tables.read_atac_table(spark, str(tmp_path / "p.tsv")).orderBy("peak_id").collect()
    assert [(r.peak_id, r.gene_symbol, r.distance_to_tss, r.openness, r.is_valid_link) for r in rows] == [(0, "B", 10.0, 1.5, True), (1, None, 20.0, 2.0, False), (2, "A", None, 3.0, False)]
    (tmp_path / "e.tsv").write_text("gene\tdistance\n")
    with pytest.raises(ValueError, match="no rows"):
        tables.read_atac_table(spark, str(tmp_path / "e.tsv"))
    (tmp_path / "n.tsv").write_text("a\tb\n1\t2\n")
    with pytest.raises(ValueError, match="no column"):
        tables.read_atac_table(spark, str(tmp_path / "n.tsv"))


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    lines = [f"r{i:05d}" for i in range(4000)]
    (tmp_path / "a.csv").write_text("x\n" + "\n".join(lines[:2500]) + "\n")
    (tmp_path / "b.csv").write_text("x\n" + "\n".join(lines[2500:]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = tables.in_file_order(spark.read.option("header", True).csv(str(tmp_path))).collect()
        (tmp_path / "m.mtx").write_text("%%MatrixMarket\n9 9 3000\n" + "".join(f"{i % 9 + 1} {i // 9 % 9 + 1} {i}\n" for i in range(3000)))
        entries = tables.read_matrix(spark, str(tmp_path / "m.mtx")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.x for r in sorted(got, key=lambda r: r.pos)] == lines and sorted(r.pos for r in got) == list(range(4000))
    assert sorted(r.value for r in entries) == [float(i) for i in range(3000)]


def test_entities_in_file_order_and_missing_files(spark, tmp_path):
    (tmp_path / "g.csv").write_text("id,name\ng9,Z\ng1,A\n")
    (tmp_path / "d.csv").write_text("id,name\nd1,X\n")
    with pytest.warns(UserWarning, match="missing"):
        rows = tables.read_entities(spark, {"Gene": (str(tmp_path / "g.csv"), "id", "name"), "Drug": (str(tmp_path / "d.csv"), "id", "name"), "Pathway": (str(tmp_path / "no.csv"), "id", "name")})
    assert [(r.id, r.type) for r in rows.orderBy("pos").collect()] == [("g9", "Gene"), ("g1", "Gene"), ("d1", "Drug")]


def test_maps_and_versions(spark, tmp_path):
    genes = spark.createDataFrame([("o1", "S", "E", "5", 2), ("o2", "T", "", "", 0)], "orig_id string, gene_symbol string, ensembl_id string, hgnc_num string, hgnc_token int")
    sinks.gene_maps(genes, str(tmp_path))
    assert json.loads(spark.read.text(str(tmp_path / "id_map.json")).first()[0]) == {"o1": "5"}
    assert spark.read.json(str(tmp_path / "gene_mapping_info.json")).count() == 2
    sinks.domain_map(spark.createDataFrame([("b", 1), ("a", 0), ("b", 1)], "batch string, domain_id long"), "batch", "domain_id", str(tmp_path / "d.json"))
    assert json.loads(spark.read.text(str(tmp_path / "d.json")).first()[0]) == {"a": 0, "b": 1}
    made = []
    make = lambda n: lambda: made.append(n) or spark.range(n)
    at = str(tmp_path / "i")
    assert [sinks.cached_index(spark, make(n), at, v).count() for n, v in ((3, "1"), (4, "1"), (5, "2"))] == [3, 3, 5] and made == [3, 5]


def test_attention_pooling(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [3.0, 2.0]], [0.0, 0.0], [0.0, 50.0])], "v array<array<double>>, s array<double>, t array<double>")
    r = df.select(sequences.pool(F.col("v"), "attention", F.col("s")).alias("a"), sequences.pool(F.col("v"), "attention", F.col("t")).alias("b"), sequences.pool(F.col("v")).alias("m")).first()
    assert r.a == r.m == [2.0, 1.0] and r.b == pytest.approx([3.0, 2.0])


def test_graph_counts_and_known_relations(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "a", "rev_x"), ("a", "c", "y")], "src string, dst string, type string")
    assert {(r.type, r.n_edges, r.n_nodes) for r in graph.counts(edges).collect()} == {("x", 1, 2), ("rev_x", 1, 2), ("y", 1, 2)}
    (tmp_path / "k.json").write_text('{"p": 0, "q": 1}')
    (tmp_path / "l.json").write_text('["p"]')
    assert tables.known_relations(spark, str(tmp_path / "l.json"), ["z"]) == ["z"] and len(tables.known_relations(spark)) == 10
    assert tables.known_relations(spark, str(tmp_path / "k.json"), ["z"]) == ["p", "q"]
    assert tables.known_relations(spark, str(tmp_path / "no.json"), ["z"]) == ["z"] == tables.known_relations(spark, None, ["z"])
