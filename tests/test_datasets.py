"""From files to intermediates and expression values, for each format; and that ranges read no more than they are asked for."""

import json
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixspark.operators import expression
from helixspark.sources import datasets, files, ranges

LONG = 5000


@pytest.fixture(scope="module")
def matrix(tmp_path_factory):
    """An annotated matrix of six cells: one is empty, one has nearly all values."""
    at = tmp_path_factory.mktemp("matrix")
    n = np.array([3, 0, LONG, 2, 0, 1])
    rng = np.random.default_rng(3)
    own = {"indptr": np.concatenate(([0], np.cumsum(n))), "indices": np.concatenate([np.arange(k) for k in n]).astype(np.int32), "data": rng.integers(1, 9, n.sum()).astype(np.float32)}
    (at / "X").mkdir()
    for name, a in own.items():
        np.save(at / "X" / f"{name}.npy", a)
    (at / "obs.csv").write_text("index,total_counts,quality,organ,cell_type\n" + "".join(f"c{i},{i * 10},{'good' if i % 2 else 'bad'},lung,\n" for i in range(6)))
    (at / "var.csv").write_text("index,gene_ids\n" + "".join(f"G{i},{f'ENSG{i}' if i % 2 else ''}\n" for i in range(LONG)))
    return at, n, own


def test_annotated_matrix(spark, matrix, tmp_path):
    at, n, own = matrix
    told = datasets.inspect_h5ad(spark, str(at))
    assert told["shape"] == (6, LONG) and told["n_stored"] == n.sum() and told["value_type"] == "float32" and told["first_genes"][:2] == ["G0", "G1"]
    read = datasets.read_h5ad(spark, str(at), str(tmp_path / "out"), "v1", {"tissue": "organ", "cellType1": "cell_type"}, "quality", "good")
    cells = read.cells.orderBy("row").collect()
    assert [(r.sample_id, r.row, r.qc_pass, r.n_counts, r.n_genes, r.tissue, r.region) for r in cells] == [(f"c{i}", i, i % 2 == 1, i * 10.0, None, "lung", "") for i in range(6)]
    genes = read.genes.orderBy("col").limit(2).collect()
    assert [(r.orig_id, r.gene_symbol, r.ensembl_id, r.gctx_index, r.is_hvg, r.col) for r in genes] == [("G0", "G0", "", -1, True, 0), ("G1", "G1", "ENSG1", -1, True, 1)]
    assert json.loads((tmp_path / "out/v1/data_source.json").read_text() if (tmp_path / "out/v1/data_source.json").is_file() else spark.read.text(f"{read.path}/data_source.json").first()[0])["format"] == "h5ad"
    got = datasets.h5ad_expression(spark, read, values=700)
    want = sorted((f"c{i}", int(c), float(v)) for i, c, v in zip(np.repeat(np.arange(6), n), own["indices"], own["data"], strict=True))
    assert sorted(map(tuple, got.collect())) == want
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        datasets.read_h5ad(spark, str(at), str(tmp_path / "out"), "v1")


def test_a_long_row_is_dealt_over_tasks_and_ranges_read_only_themselves(spark, matrix):
    at, n, own = matrix
    sizes = [r[1] for r in ranges.read_csr(spark, str(at / "X"), values=500).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n.sum() and max(sizes) <= 500 and len(sizes) >= LONG // 500
    few = ranges.read_csr(spark, str(at / "X"), (3, 6))
    assert sorted({r.row for r in few.collect()}) == [3, 5] and few.count() == 3
    assert ranges.read_csr(spark, str(at / "X"), (4, 5)).count() == 0

    class Counting:
        def __init__(self, file):
            self.file, self.bytes = file, 0

        def read_at(self, n, offset):
            self.bytes += n
            return self.file.read_at(n, offset)

    system, path = ranges.open_uri(str(at / "X" / "data.npy"))
    with system.open_input_file(path) as file:
        counted, array = Counting(file), ranges.stored(str(at / "X" / "data.npy"))
        assert (array.read(counted, 10, 14) == own["data"][10:14]).all() and counted.bytes == 16


def test_pointers_in_blocks(monkeypatch, matrix):
    at, n, own = matrix
    monkeypatch.setattr(ranges, "POINTERS", 2)
    monkeypatch.setattr(ranges, "BATCH", 64)
    reader = ranges.CsrReader({"path": str(at / "X"), "values": "333"})
    got = [tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert got == [(int(i), int(c), float(v)) for i, c, v in zip(np.repeat(np.arange(6), n), own["indices"], own["data"], strict=True)]


def test_signature_set(spark, tmp_path):
    rng = np.random.default_rng(0)
    values = rng.normal(size=(30, 40)).astype(np.float32)
    values[3] = 0
    values[4, :20] = 1.5  # ties
    np.save(tmp_path / "m.npy", values)
    (tmp_path / "sig.txt").write_text("sig_id\tpert_id\tcell_iname\tok\n" + "".join(f"s{i}\tp{i % 4}\tx{i % 3}\t{i % 2}\n" for i in range(30)))
    (tmp_path / "cell.txt").write_text("cell_iname\tlineage\nx0\tlung\nx1\tskin\nx0\tother\n")
    (tmp_path / "cmpd.txt").write_text("pert_id\tcmap_name\np0\taspirin\np1\tb\np1\tc\n")
    (tmp_path / "gene.txt").write_text("gene_id\tgene_symbol\tensembl_id\n" + "".join(f"{100 + i}\tG{i}\tE{i}\n" for i in range(40)))
    path = lambda n: str(tmp_path / n)
    told = datasets.inspect_gctx(spark, path("m.npy"), path("gene.txt"), path("sig.txt"), 2)
    assert told["shape"] == [30, 40] and told["value_type"] == "float32" and told["genes"] == {"columns": ["gene_id", "gene_symbol", "ensembl_id"], "first": ["100", "101"]} and told["signatures"]["first"] == ["s0", "s1"]
    read = datasets.read_gctx(spark, path("m.npy"), path("sig.txt"), path("cell.txt"), path("cmpd.txt"), path("gene.txt"), path("out"), "v1", {"tissue": "lineage", "drug": "cmap_name"}, qc_col="ok", qc_val="1", literals=datasets.SIGNATURE_LITERALS)
    rows = read.cells.orderBy("row").collect()
    assert [(r.sample_id, r.qc_pass, r.tissue, r.drug, r.region, r.perturbType, r.n_genes) for r in rows[:3]] == [("s0", False, "lung", "aspirin", "none", "", None), ("s1", True, "skin", "b", "none", "", None), ("s2", False, None, None, "none", "", None)]
    assert [(r.orig_id, r.gene_symbol, r.gctx_index) for r in read.genes.orderBy("gctx_index").limit(2).collect()] == [("100", "G0", 0), ("101", "G1", 1)]
    assert read.source.extra == {"shape": [30, 40]}
    tokens = spark.range(40).select(F.col("id").cast("int").alias("gene_idx"), F.when(F.col("id") % 3 != 0, F.col("id") + 1).otherwise(0).alias("token"))
    got = datasets.gctx_tokens(spark, read, tokens, 8, 16, 4)
    long = expression.to_long(datasets.gctx_rows(spark, read), "cell_id", "values")
    top = expression.top_genes(long, 8, 16, use_abs=True, over=4, tokens=tokens)
    want = {(r.cell_id, r.rank): (r.token, r.bin) for r in top.collect()}
    assert {(r.cell_id, i + 1): (r.gene_ids[i], r.bin_ids[i]) for r in got.collect() for i in range(r.lengths)} == want
    assert all(r.gene_ids[r.lengths :] == [0] * (8 - r.lengths) for r in got.collect())
    chunk = expression.top_genes_dense(ranges.read_dense(spark, path("m.npy")), "row", "values", tokens, 8, 16, 4, True)
    assert "Exchange" not in chunk._jdf.queryExecution().executedPlan().toString()


def test_dense_top_genes_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [float("nan"), -2.0, None, 2.0]), (4, [0.0] * 9)], "cell string, v array<double>")
    tokens = spark.createDataFrame([(1, 11), (3, 13), (8, 18)], "gene_idx int, token int")
    got = {r.cell: (r.gene_ids, r.lengths) for r in expression.top_genes_dense(df, "cell", "v", tokens, 3, 4, 1, use_abs=True).collect()}
    assert got == {"1": ([0, 0, 0], 0), "2": ([0, 0, 0], 0), "3": ([11, 13, 0], 2), "4": ([11, 13, 0], 2)}
    none = tokens.limit(0)
    assert {r.lengths for r in expression.top_genes_dense(df, "cell", "v", none, 3, 4).collect()} == {0}


@pytest.fixture(scope="module")
def arrow_set(tmp_path_factory):
    root = tmp_path_factory.mktemp("set")

    def save(subset, table, names=("test", "train"), rows=50):
        for k, split in enumerate(names or [""]):
            at = root / subset / split
            at.mkdir(parents=True)
            part = table.slice(0, table.num_rows - k)
            with pa.ipc.new_stream(at / "data-00000-of-00001.arrow", part.schema) as w:
                w.write_table(part, max_chunksize=rows)
        if names:
            (root / subset / "dataset_dict.json").write_text(json.dumps({"splits": list(names)}))

    n = 1000
    save("obs_metadata", pa.table({"plate": ["p"] * n, "BARCODE_SUB_LIB_ID": [f"b{i}" for i in range(n)], "num_genes": list(range(n)), "cell_name": [f"l{i % 3}" for i in range(n)], "pass_filter": ["full" if i % 2 else "none" for i in range(n)], "drug": pa.array([f"d{i % 2}" for i in range(n)]).dictionary_encode()}))
    save("gene_metadata", pa.table({"token_id": [3, 4], "gene_symbol": ["A", "B"], "ensembl_id": ["E1", None]}), names=None)
    save("cell_line_metadata", pa.table({"cell_name": ["l0", "l1", "l0"], "Organ": ["lung", "skin", "liver"]}), names=("train",))
    save("expression_data", pa.table({"genes": [[1, 2, 3]] * n, "expressions": [[0.5, 1.0, float(i)] for i in range(n)], "BARCODE_SUB_LIB_ID": [f"b{i}" for i in range(n)], "more": ["x" * 100] * n}), names=None, rows=10)
    return str(root)


def test_arrow_set(spark, arrow_set, tmp_path):
    told = datasets.inspect_set(spark, arrow_set)
    assert told["splits"] == ["test", "train"] and told["num_rows"] == 1000 and told["column_names"][0] == "plate" and told["sample"]["plate"] == "p"
    assert datasets.inspect_set(spark, arrow_set, "gene_metadata")["splits"] == ["(single)"]
    read = datasets.read_hf_dataset(spark, arrow_set, str(tmp_path / "out"), "v1", {"tissue": "Organ", "drug": "drug"}, "pass_filter", "full", literals=datasets.SET_LITERALS)
    assert read.cells.count() == 999  # the preferred split, not the first
    got = {r.sample_id: (r.n_genes, r.qc_pass, r.tissue, r.drug, r.perturbType, r.age) for r in read.cells.where("sample_id in ('b0', 'b1', 'b2')").collect()}
    assert got["b1"] == (1.0, True, "skin", "d1", "drug", "none") and got["b2"][2] is None and got["b0"][2] in ("lung", "liver")
    assert sorted((r.orig_id, r.orig_token_id, r.gene_symbol) for r in read.genes.collect()) == [("3", 3, "A"), ("4", 4, "B")]


def test_one_file_is_read_by_several_tasks(spark, arrow_set):
    rows = datasets.set_expression(spark, arrow_set, task_bytes=20_000)
    by_task = rows.groupBy(F.spark_partition_id()).count().collect()
    assert len(by_task) > 4 and sum(r[1] for r in by_task) == 1000 and rows.columns == ["cell_id", "genes", "values"]
    assert sorted(r["values"][2] for r in rows.collect()) == [float(i) for i in range(1000)]
    with pytest.raises(ValueError, match="absent"):
        datasets.set_expression(spark, arrow_set, genes="absent")
    index = files.arrow_index(files.files_of(spark, f"{arrow_set}/expression_data"))
    assert index.agg(F.sum("rows")).first()[0] == 1000 and index.count() == 100


def test_vectors(spark, tmp_path):
    values = np.arange(24, dtype=np.float32).reshape(6, 4)
    (tmp_path / "ids.json").write_text(json.dumps({f"e{i}": i for i in range(6)}))
    (tmp_path / "five.json").write_text(json.dumps([f"e{i}" for i in range(5)]))
    (tmp_path / "raw.bin").write_bytes(values.tobytes())
    np.save(tmp_path / "v.npy", values)
    with zipfile.ZipFile(tmp_path / "v.pt", "w") as z:
        z.writestr("archive/data.pkl", b"pickled")
        z.writestr("archive/data/0", values.tobytes())
        z.writestr("archive/version", b"3")
    want = {f"e{i}": values[i].tolist() for i in range(6)}
    for name in ("raw.bin", "v.npy", "v.pt"):
        # the first source isn't there, the second has another number of rows
        sources = [(f"{tmp_path}/ids.json", f"{tmp_path}/none"), (f"{tmp_path}/five.json", f"{tmp_path}/{name}"), (f"{tmp_path}/ids.json", f"{tmp_path}/{name}")]
        got, path = datasets.read_vectors(spark, sources, width=4)
        assert path.endswith(name) and {r.id: r.vec for r in got.collect()} == want
        part = ranges.read_dense(spark, f"{tmp_path}/{name}", (2, 4), "float32", 4, bytes_of_task=16)
        assert sorted((r.row, r["values"]) for r in part.collect()) == [(2, values[2].tolist()), (3, values[3].tolist())] and part.rdd.getNumPartitions() == 2
    with pytest.raises(FileNotFoundError):
        datasets.read_vectors(spark, [(f"{tmp_path}/five.json", f"{tmp_path}/v.npy")])
    with pytest.raises(ValueError, match="aren't rows"):
        ranges.stored(f"{tmp_path}/raw.bin", "float32", 5)
    with pytest.raises(ValueError, match="no header"):
        ranges.stored(f"{tmp_path}/raw.bin")


def test_gene_debug_table(spark):
    info = spark.createDataFrame([(0, "1"), (1, "2"), (2, "9")], "gctx_index int, entrez_id string")
    mapped = spark.createDataFrame([("1", "E1", "A", "5", 7), ("2", "E2", "B", "", 0)], "entrez_id string, ensembl_norm string, gene_symbol string, hgnc_num string, hgnc_token long")
    got = datasets.gene_debug_table(info, mapped).orderBy("gctx_gene_index").collect()
    assert [tuple(r) for r in got] == [(0, "1", "E1", "A", "5", 7), (1, "2", "E2", "B", "", 0), (2, "9", None, None, None, 0)]
