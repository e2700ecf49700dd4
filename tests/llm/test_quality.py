"""Perplexities don't depend on how documents are split or in which order they come, not even if it changes between reads."""

import random

import pytest
from pyspark.sql import functions as F

quality = pytest.importorskip("helixspark.llm.quality")


def test_any_order_and_splits(spark, monkeypatch):
    rnd = random.Random(2)
    texts = [" ".join("".join(rnd.choice("abcdé中文字") for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(0, 50))) for _ in range(150)] + [None, "", "x" * 4000]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    trusted = spark.range(80).select(F.col("id").alias("doc_id"))

    def found(df):
        return {r.doc_id: (r.n_chars, r.perplexity and round(r.perplexity, 4)) for r in quality.perplexities(df, trusted).collect()}

    want = found(docs.coalesce(1))
    assert len(want) == len(texts) and want[150][1] is None and want[0][1] > 1
    monkeypatch.setattr(quality, "BLOCK", 3000)
    assert found(docs.coalesce(1)) == want
    assert found(docs.orderBy(F.rand())) == want  # another order at every read
    assert found(docs.repartition(7)) == want
