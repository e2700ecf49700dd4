"""Exact quantiles, running sums and the metrics made of them, against NumPy; and what a task holds of a hot group."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixspark.operators import expression, metrics, order


def frame(spark, groups):
    return spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "name string, x double").repartition(5)


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(6)
    hot = [float(v) for v in rng.normal(size=9001)]
    return {
        "hot": hot, "ties": [1.0] * 5000 + [2.0] * 4000, "steep": [float(v) for v in 2.0 ** -np.arange(0, 900.0)] * 6, "two": [3.0, 4.5], "one": [7.0], "none": [None],
        "wide": [-1.7e308, 1.7e308, 5e-324, 0.0, -0.0, None], "odd": [math.nan, math.inf, -math.inf, -math.inf, 1.0, 2.0], "nan": [math.nan], "inf": [-math.inf, 5.0, math.inf],
    }


def test_quantiles(spark, groups, monkeypatch):
    shares = {"low": 0.0, "third": 0.3, "median": 0.5, "high": 1.0}
    for few in (4096, 600):
        monkeypatch.setattr(order, "FEW", few)
        got = {r.name: r for r in order.quantiles(frame(spark, groups), "x", shares, "name").collect()}
        assert set(got) == set(groups) - {"none"}
        for name, values in groups.items():
            known = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
            for share, q in shares.items():
                if known:
                    at = q * (len(known) - 1)
                    a, b, part = known[math.floor(at)], known[math.ceil(at)], at - math.floor(at)
                    want = a if part == 0 or a == b else a * (1 - part) + b * part
                    assert got[name][share] == want or (math.isnan(want) and math.isnan(got[name][share])) or abs(got[name][share] - want) < 1e-12 * abs(want), (name, share)


def test_quantiles_without_groups_and_rows(spark, groups):
    df = frame(spark, {"hot": groups["hot"]})
    assert order.quantiles(df, "x", {"median": 0.5}).first()["median"] == float(np.median(groups["hot"]))
    assert order.quantiles(df.limit(0), "x", {"median": 0.5}).count() == 0
    cells = spark.createDataFrame([(1, 2.0, None), (2, 4.0, None), (5, None, None)], "n_genes int, n_counts double, pct_mt double")
    assert tuple(expression.medians(cells).first()) == (2.0, 3.0, None)


def test_no_plan_holds_a_groups_values(spark, groups):
    plan = order.quantiles(frame(spark, {"hot": groups["hot"]}), "x", {"median": 0.5}, "name")._jdf.queryExecution().executedPlan().toString()
    assert "median(" not in plan and "percentile" not in plan


def test_running_sums_of_a_hot_group(spark):
    rows = [("hot", float(i * 7 % 1000), i % 5 - 2) for i in range(1000)] + [("b", 1.0, 4), ("c", 2.0, 1), ("c", 3.0, 1)]
    df = spark.createDataFrame(rows, "g string, v double, w int")
    got = order.running(df, "g", ["v"], "w", "v")
    want, total, own = {}, {}, sorted(rows)
    for (g, v, w), after in zip(own, [*own[1:], (None, None, None)], strict=True):
        total[g] = total.get(g, 0) + w
        want[g, v] = (total[g], after[1] if after[0] == g else None)
    assert {(r.g, r.v): (r.total, r.next) for r in got.collect()} == want and got.columns == ["g", "v", "w", "total", "next"]
    assert order.running(df.limit(0), "g", ["v"], "w").count() == 0


@pytest.mark.parametrize("spread", [0.3, 40.0])
@pytest.mark.parametrize("gamma", [1.0, 0.05])
def test_mmd_is_exact_to_its_bound(spark, spread, gamma):
    rng = np.random.default_rng(8)
    y, f = rng.normal(0, spread, (300, 3)), rng.normal(0.2, spread, (300, 3))
    f[:, 2] = y[:, 2]
    df = spark.createDataFrame([(i, g, float(y[i, g]), float(f[i, g])) for i in range(300) for g in range(3)] + [(300, 0, None, 1.0), (301, 1, math.nan, 1.0), (302, 1, 1.0, math.inf)], "sample_id int, gene_idx int, y double, f double")
    k = lambda a, b: np.exp(-gamma * (a[:, None] - b) ** 2).mean()
    want = np.mean([k(y[:, g], y[:, g]) + k(f[:, g], f[:, g]) - 2 * k(y[:, g], f[:, g]) for g in range(3)])
    assert abs(metrics.mmd(df, gamma).first().mmd - want) < 1e-11
    plan = metrics.mmd(df, gamma)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_wasserstein(spark):
    rng = np.random.default_rng(8)
    y, f = rng.integers(0, 30, (400, 2)).astype(float), rng.normal(9, 4, (400, 2))
    df = spark.createDataFrame([(i, g, float(y[i, g]), float(f[i, g])) for i in range(400) for g in range(2)] + [(400, 0, None, 1.0)], "sample_id int, gene_idx int, y double, f double")
    want = np.mean([np.abs(np.sort(y[:, g]) - np.sort(f[:, g])).mean() for g in range(2)])
    assert abs(metrics.wasserstein(df).first().wasserstein - want) < 1e-12
    same = df.withColumn("f", F.col("y"))
    assert metrics.wasserstein(same).first().wasserstein == 0
