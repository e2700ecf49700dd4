"""Queries take their whole input; compared with brute force in Python."""

import re

import numpy as np
import pytest

from helixspark.plans import catalog


def test_descriptions_of_whole_texts(spark, sf):
    def clean(text):
        t = re.sub(r"\A[A-Za-z0-9 _]+:\s*", "", ("NCBI Gene: " + text.replace("\n", " ") + " [Source:HGNC;Acc:1] | rest").strip(" "))
        t = re.sub(r"(?s)\s*\[Source:.*?\]", "", t).split("|")[0].strip(" ")
        at = t.find(". ")
        return t[: at + 1] if 20 < at < 220 else t[:220]

    want = {r["doc_id"]: clean(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["clean"] for r in catalog.QUERIES["desc_clean"](spark, sf).collect()}
    assert got == want
    assert any(len(x) > 150 for x in got.values())


def test_mmd_over_all_genes(spark, sf):
    rows = {r["vec_id"]: np.array(r["embedding"], dtype="float64") for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()}
    ids = [i for i in sorted(rows) if i % 2 == 0 and i + 1 in rows]
    y, f = np.array([rows[i] for i in ids]), np.array([rows[i + 1] for i in ids])
    mean = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2)).mean(axis=(0, 1))
    want = (mean(y, y) + mean(f, f) - 2 * mean(y, f)).mean()
    assert y.shape[1] == 64
    assert abs(catalog.QUERIES["metric_mmd"](spark, sf).collect()[0]["mmd"] - want) < 2e-6


@pytest.mark.parametrize("name", ["hop_select", "subgraph", "candidate_scores", "render_text", "embedding_attach"])
def test_every_nation_and_supplier_is_a_seed(spark, sf, name):
    keys = lambda t, k: {f"{t}:{r[0]}" for r in spark.read.parquet(f"{sf}/{t}.parquet").select(k).collect()}
    seeds = {r["seed"] for r in catalog.QUERIES[f"kg_{name}"](spark, sf).select("seed").distinct().collect()}
    assert seeds == keys("nation", "n_nationkey") | keys("supplier", "s_suppkey")


@pytest.mark.parametrize("name", ["seed", "fuzzy"])
def test_every_nation_and_customer_is_resolved(spark, sf, name):
    column = lambda t, c: [r[0] for r in spark.read.parquet(f"{sf}/{t}.parquet").select(c).collect()]
    want = {x.upper() for x in column("nation", "n_name")} | {x[-4:] for x in column("customer", "c_name")} | {"no such thing"}
    got = [r["seed"] for r in catalog.QUERIES[f"kg_resolve_{name}"](spark, sf).collect()]
    assert sorted(got) == sorted(want)
