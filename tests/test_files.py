"""Arrow streams and files, and NPZ shards: what is read is what was written."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixspark.operators import graph
from helixspark.sources import files


def test_arrow_streams_and_files(spark, tmp_path):
    t = pa.table({"cell": ["a", "b", "c", None], "genes": [[1, 2], [], None, [5]], "expressions": [[0.5, 1.5], [], None, [2.0]], "more": [1, 2, 3, 4]})
    with pa.ipc.new_stream(tmp_path / "one.arrow", t.schema) as w:
        w.write_table(t, max_chunksize=2)
    with pa.ipc.new_file(tmp_path / "two.arrow", t.schema) as w:
        w.write_table(t)
    got = files.read_arrow(spark, str(tmp_path), ["cell", "genes", "expressions"])
    assert got.columns == ["cell", "genes", "expressions"]
    want = [(r["cell"], r["genes"], r["expressions"]) for r in t.to_pylist()] * 2
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert files.read_arrow(spark, str(tmp_path)).count() == 8
    with pytest.raises(ValueError, match="absent"):
        files.read_arrow(spark, str(tmp_path), ["cell", "absent"])
    with pytest.raises(FileNotFoundError):
        files.read_arrow(spark, str(tmp_path), suffix=".none")


def test_shards_round_trip(spark, tmp_path):
    rows = [(i // 3, f"s{i:02d}", [i, 0, 7], [3, 2, 1], 3, i % 2, [f"t{i}", "none"]) for i in range(8)]
    df = spark.createDataFrame(rows, "shard_id long, sample_id string, gene_ids array<int>, bin_ids array<smallint>, lengths smallint, domain_id int, text_data array<string>")
    assert files.write_shards(df.repartition(5), f"file://{tmp_path}") == [f"shard_{i:05d}.npz" for i in range(3)]
    with np.load(tmp_path / "shard_00000.npz") as one:
        assert one["gene_ids"].dtype == np.int32 and one["bin_ids"].dtype == np.int16 and list(one["sample_id"]) == ["s00", "s01", "s02"]
    got = files.read_shards(spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == [r[1:] for r in rows]


def test_shards_of_objects_need_trust(spark, tmp_path):
    text = np.array([["a", "b"]], dtype=object)
    np.savez_compressed(tmp_path / "shard_00000.npz", sample_id=np.array(["x"], dtype=object), gene_ids=np.zeros((1, 2), np.int32), bin_ids=np.zeros((1, 2), np.int16), lengths=np.zeros(1, np.int16), domain_id=np.zeros(1, np.int32), text_data=text)
    assert files.read_shards(spark, str(tmp_path), allow_pickle=True).first()["text_data"] == ["a", "b"]
    with pytest.raises(Exception, match="allow_pickle"):
        files.read_shards(spark, str(tmp_path)).collect()


def test_names_that_hold_seeds(spark):
    names = [(str(i), n) for i, n in enumerate(["alpha", "alphabet", "b", "xy", "", None, "aaa", "beta xyz", "al"])]
    seeds = ["alpha", "pha", "a", "xy", "zzz", "aa", "b", "ta x", "alphabets"]
    n = spark.createDataFrame(names, "id string, low string")
    s = spark.createDataFrame([(x,) for x in seeds], "key string")
    best = F.struct(F.length("low").alias("n"), "low", "id")
    got = {r["key"]: tuple(r["best"]) for r in graph.holding(n, s, best).collect()}
    assert got == {x: min((len(low), low, i) for i, low in names if low and x in low) for x in seeds if any(low and x in low for _, low in names)}
    assert graph.holding(n, s.limit(0), best).count() == 0


def test_what_seeds_shuffle_is_bounded_by_seeds(spark):
    """Two thousand names hold a seed of one letter and one of four: each task sends one row for each."""
    nodes = spark.range(2000).select(F.concat(F.lit("x:"), "id").alias("id"), F.concat(F.lit("name "), "id").alias("name"), F.lit("Gene").alias("type"), F.col("id").alias("pos"))
    seeds = spark.createDataFrame([("n",), ("name",)], "seed string")
    df = graph.resolve_seeds(seeds, nodes)
    assert [(r.seed, r.id) for r in df.orderBy("seed").collect()] == [("n", "x:0"), ("name", "x:0")]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Window" not in plan


def test_neighbours_of_a_hub_are_dealt_to_parts(spark):
    e = spark.createDataFrame([("hub", f"n{i}", "t") for i in range(50)] + [("leaf", "hub", "t")], "src string, dst string, type string")
    rows = graph.adjacency(e, 10).collect()
    hub = [r for r in rows if r["src"] == "hub"]
    assert len({r["part"] for r in hub}) == len(hub) > 1 and {r["degree"] for r in hub} == {50}
    assert sorted(x["dst"] for r in hub for x in r["neighbours"]) == sorted(f"n{i}" for i in range(50))
    assert [(r["part"], r["degree"]) for r in rows if r["src"] == "leaf"] == [(0, 1)]
