"""Top products over several blocks against brute force: which pairs are sent, ties, lengths and repeated rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

topk = pytest.importorskip("helixspark.llm.topk")


def by_hand(rows, k):
    out = []
    once = {}
    for i, v in rows:
        once.setdefault(i, []).append(tuple(v))
    for q in sorted(i for i in once if i % 10 == 0):
        asked = min(once[q])
        scores = sorted((-max(sum(a * b for a, b in zip(asked, v)) for v in vs if len(v) == len(asked)), i) for i, vs in once.items() if i != q and any(len(v) == len(asked) for v in vs))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>").repartition(4)
    return sorted(tuple(r) for r in topk.top_products(df, F.col("id") % 10 == 0, **options).collect())


def test_blocks_that_cannot_hold_a_best_product_are_not_sent(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    centres *= 300 / np.linalg.norm(centres, axis=1)[:, None]
    x = np.floor(centres[rng.integers(0, 40, 2000)] + rng.normal(0, 6, (2000, 16))).astype(int)
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    told = {}
    assert run(spark, rows, k=5, block_rows=100, query_rows=64, told=told) == by_hand(rows, 5)
    assert told["share"] < 0.3, told


def test_random_ties_lengths_and_copies(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v) for i, v in enumerate(rng.integers(-2, 3, (300, 4)).tolist())]
    rows += [(300 + i, v) for i, v in enumerate(rng.integers(-9, 9, (60, 3)).tolist())] + [rows[7], (8, rows[9][1]), (10, [2, 2, 2, 2]), (400, [1, 2]), (500, [0] * 4)]
    for block in (40, 150):
        assert run(spark, rows, k=4, block_rows=block, query_rows=8, drawn=64) == by_hand(rows, 4)
    assert run(spark, rows, k=4) == by_hand(rows, 4)  # all in one block


def test_a_length_that_was_not_drawn(spark):
    rows = [(i, [i % 7, 1]) for i in range(60)] + [(1000, [1, 2, 3]), (1010, [3, 2, 1])]
    assert run(spark, rows, k=3, block_rows=20, drawn=1) == by_hand(rows, 3)


def test_rows_are_sent_in_batches_of_bounded_size(spark, monkeypatch):
    """Nothing is ruled out here, so each query meets all blocks."""
    monkeypatch.setattr(topk, "SENT", 1 << 12, raising=False)
    kind = type(spark.range(1))
    real = kind.mapInArrow

    def checked(self, run, schema, *more, **named):
        def few(batches):
            for b in run(batches):
                assert "kth" in b.schema.names or "far" in b.schema.names or b.num_rows * 16 <= 1 << 12, b.num_rows
                yield b

        return real(self, few, schema, *more, **named)

    monkeypatch.setattr(kind, "mapInArrow", checked)
    rng = np.random.default_rng(6)
    rows = [(i, v) for i, v in enumerate(rng.integers(-99, 99, (1200, 16)).tolist())]
    assert run(spark, rows, k=3, block_rows=100, query_rows=64) == by_hand(rows, 3)
