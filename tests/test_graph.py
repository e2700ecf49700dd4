"""Expansion against a plain loop, over more hops; its plans; the edge index; batches over seeds that die and go on."""

import random

import pytest
from pyspark.sql import functions as F

from helixspark.operators import graph
from helixspark.plans import catalog, pipelines
from helixspark.sources import sinks

CAPS = {"A": 3, "B": 4, "C": 2, "*": 2}
BONUS, EDGE = {"A": 2.0, "B": 1.0}, {"x": 0.5, "y": -0.2}


def by_hand(seed, start, nodes, edges, hops, most):
    """One seed's nodes and edges, in order."""
    types = {i: (t, d) for i, _, t, d in nodes}
    known = {start: (0, 1)}
    order, recorded = [start], []
    for hop in range(1, hops + 1):
        if len(known) >= most:
            break
        counts = {}
        for i in known:
            counts[types[i][0]] = counts.get(types[i][0], 0) + 1
        frontier = {i: o for i, (h, o) in known.items() if h == hop - 1}
        met = [(s, d, k, frontier[s]) for s, d, k in edges if s in frontier]
        cands = {}
        for s, d, k, f in met:
            if d in known:
                recorded.append((hop, 0, 0, f, d, s, k))
                continue
            t, desc = types[d]
            score = round(BONUS.get(t, 0.4) + EDGE.get(k, 0.0) + (0.8 if desc else 0) + max(0, 1.8 - 0.35 * counts.get(t, 0)), 9)
            old = cands.get(d, (-99, (99, "", "")))
            cands[d] = (max(old[0], score), min(old[1], (f, d, k)))
        chosen = []
        for t in sorted({types[d][0] for d in cands}):
            own = sorted((d for d in cands if types[d][0] == t), key=lambda d: (-cands[d][0], cands[d][1]))
            room = CAPS.get(t, CAPS["*"]) - counts.get(t, 0)
            quota = min(room, max(1, -(-room // (hops - hop + 1)))) if room > 0 else 0
            first_met = min(cands[d][1] for d in own)
            for r, d in enumerate(own[:quota]):
                key = (0, counts.get(t, 0), -BONUS.get(t, 0.0), first_met) if r == 0 else (1, 0, 0, (0, "", ""))
                chosen.append((*key, -cands[d][0], cands[d][1], d))
        picked = {c[-1]: n + 1 for n, c in enumerate(sorted(chosen)[: most - len(known)])}
        recorded += [(hop, 1, picked[d], f, d, s, k) for s, d, k, f in met if d in picked]
        known |= {d: (hop, n) for d, n in picked.items()}
        order += list(picked)
    seen, out = set(), []
    for hop, _, _, _, d, s, k in sorted(recorded):
        if (s, d, k) not in seen:
            seen.add((s, d, k))
            out.append((seed, s, d, k, hop))
    return [(seed, i, known[i][0]) for i in order], out


@pytest.fixture(scope="module")
def made(spark):
    rnd = random.Random(4)
    nodes = [(f"n{i:02d}", f"N{i}", "ABCD"[i % 4], "told" if i % 3 else "") for i in range(40)]
    edges = [(f"n{rnd.randrange(40):02d}", f"n{rnd.randrange(40):02d}", rnd.choice("xyz")) for _ in range(160)]
    edges += edges[:5]
    return nodes, edges, spark.createDataFrame(nodes, "id string, name string, type string, desc string"), spark.createDataFrame(edges, "src string, dst string, type string")


@pytest.mark.parametrize("hops", [1, 4])
def test_expansion_matches_a_loop(spark, made, hops):
    nodes, edges, n, e = made
    seeds = [(f"s{i}", f"n{i:02d}") for i in range(6)]
    got_n, got_e = graph.expand(spark.createDataFrame(seeds, "seed string, id string"), n, e, hops, 9, CAPS, BONUS, EDGE)
    want = [by_hand(s, i, nodes, edges, hops, 9) for s, i in seeds]
    assert [(r.seed, r.id, r.hop) for r in got_n.orderBy("seed", "ord").collect()] == [x for w in want for x in w[0]]
    assert [(r.seed, r.src, r.dst, r.type, r.hop) for r in got_e.orderBy("seed", "ord").collect()] == [x for w in want for x in w[1]]
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_plans_do_not_grow_with_hops(spark, made):
    _, _, n, e = made
    seeds = spark.createDataFrame([("s", "n00")], "seed string, id string")
    size = lambda hops: graph.expand(seeds, n, e, hops, 9, CAPS, BONUS, EDGE)[1]._jdf.queryExecution().executedPlan().toString().count("\n")
    assert size(5) == size(2)


def test_no_hops_and_no_seeds(spark, made):
    _, _, n, e = made
    seeds = spark.createDataFrame([("s", "n00"), ("t", "unknown")], "seed string, id string")
    nodes, edges = graph.expand(seeds, n, e, 0, 9)
    assert [(r.seed, r.name, r.type) for r in nodes.orderBy("seed").collect()] == [("s", "N0", "A"), ("t", "unknown", "Unknown")] and edges.count() == 0
    nodes, edges = graph.expand(seeds.limit(0), n, e, 2, 9)
    assert nodes.count() == edges.count() == 0


def test_edge_index(spark, made, tmp_path):
    _, edges, _, e = made
    made_ = []
    make = lambda: made_.append(1) or e
    path = f"file://{tmp_path}/edges"
    for _ in range(2):
        table = sinks.edge_index(spark, make, "test_edges", path, "v1", 4)
        assert sorted(map(tuple, table.collect())) == sorted(edges)
    assert len(made_) == 1
    frontier = spark.createDataFrame([("s", "n00", 1), ("s", "n01", 2)], "seed string, src string, f int").hint("merge")
    met = graph.frontier_edges(frontier, table)
    plan = met._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    join, scan = (next(i for i, x in enumerate(lines) if word in x) for word in ("SortMergeJoin", "FileScan parquet"))
    assert not any("Exchange" in x for x in lines[join + 1 : scan]), plan
    assert sorted((r.src, r.dst, r.edge_type) for r in met.collect()) == sorted(x for x in edges if x[0] in ("n00", "n01"))
    sinks.edge_index(spark, make, "test_edges", path, "v2", 4)
    assert len(made_) == 2
    spark.sql("DROP TABLE test_edges")


def test_batches_go_on_and_no_line_stands_twice(spark, made, tmp_path):
    _, _, n, e = made
    n = n.withColumn("pos", F.monotonically_increasing_id())
    seeds = spark.createDataFrame([(f"N{i}",) for i in range(8)] + [("no such",), ("N1",), (None,)], "seed string")
    out, calls = f"file://{tmp_path}/out", []

    def make(todo):
        calls.append(sorted(r[0] for r in todo.collect()))
        if len(calls) == 2:
            raise KeyboardInterrupt  # the driver is killed between batches
        return pipelines.subgraphs(todo, n, e, max_hops=1, max_nodes=5)

    with pytest.raises(KeyboardInterrupt):
        pipelines.subgraph_batches(seeds, out, make, 3)
    half = sinks.appended(spark, out).count()
    assert 0 < half < 9
    rows = pipelines.subgraph_batches(seeds, out, make, 3).collect()
    assert sorted(r.seed for r in rows) == sorted({f"N{i}" for i in range(8)} | {"no such"})
    assert {r.seed: r.status for r in rows}["no such"] == "not found" and not set(calls[0]) & set(sum(calls[2:], []))
    assert pipelines.subgraph_batches(seeds, out, make, 3).count() == 9 and len(calls) == 4


def test_a_seed_that_fails_has_a_record(spark, tmp_path):
    seeds = spark.createDataFrame([(f"N{i}",) for i in range(6)], "seed string")
    bad = F.when(F.col("seed") == "N3", F.raise_error(F.lit("broken"))).otherwise(F.lit("ok"))
    rows = pipelines.subgraph_batches(seeds, f"file://{tmp_path}/out", lambda t: t.select("seed", bad.alias("status"))).collect()
    assert sorted((r.seed, r.status) for r in rows) == [(f"N{i}", "failed" if i == 3 else "ok") for i in range(6)]
    assert "broken" in next(r.error for r in rows if r.seed == "N3")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hubs_are_met_in_part_and_give_the_same(spark, monkeypatch, seed):
    monkeypatch.setattr(graph, "HUB", 1, raising=False)
    rnd = random.Random(seed)
    name = "n{:03d}".format
    nodes = [(name(i), f"N{i}", "ABCD"[rnd.randrange(4)], "told" if rnd.random() < 0.5 else "") for i in range(900)]
    hubs = range(200, 208)
    edges = [(name(h), name(i), rnd.choice("xyz")) for h in hubs for i in range(900) if rnd.random() < 0.7]
    edges += [(name(h), name(i), "x") for h in hubs for i in range(0, 900, 9)] + [(name(rnd.randrange(900)), name(rnd.choice(hubs)), rnd.choice("xyz")) for _ in range(2700)]
    edges += edges[:50]
    seeds = [(f"s{i:03d}", name(i)) for i in range(195, 240)]
    shared, real = [], graph.Stage
    monkeypatch.setattr(graph, "Stage", lambda df, what: shared.append(real(df, what)) or shared[-1])
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got_n, got_e = graph.expand(frame(seeds, "seed string, id string"), frame(nodes, "id string, name string, type string, desc string"), frame(edges, "src string, dst string, type string"), 3, 12, CAPS, BONUS, EDGE)
    want = [by_hand(s, i, nodes, edges, 3, 12) for s, i in seeds]
    assert [(r.seed, r.id, r.hop) for r in got_n.orderBy("seed", "ord").collect()] == [x for w in want for x in w[0]]
    assert [(r.seed, r.src, r.dst, r.type, r.hop) for r in got_e.orderBy("seed", "ord").collect()] == [x for w in want for x in w[1]]
    assert any(x.df.columns[:2] == ["seed", "node_type"] and not x.df.isEmpty() for x in shared)  # targets that two hubs share were looked for


def test_a_hub_of_many_seeds_is_not_met_whole(spark, monkeypatch):
    """As many seeds as the hub has neighbours: rows that are met grow with seeds, not with their square."""
    n, met = 400, []
    real = graph.Grown.add
    monkeypatch.setattr(graph.Grown, "add", lambda self, part: met.append(real(self, part).count()) or self.spark.read.schema(self.schema).parquet(self.parts[-1]))
    nodes = [("hub", "H", "A", "")] + [(f"n{i:03d}", f"N{i}", "B", "") for i in range(n)]
    edges = [(x, y, "x") for i in range(n) for x, y in (("hub", f"n{i:03d}"), (f"n{i:03d}", "hub"))]
    seeds = [(f"n{i:03d}", f"n{i:03d}") for i in range(n)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got, _ = graph.expand(frame(seeds, "seed string, id string"), frame(nodes, "id string, name string, type string, desc string"), frame(edges, "src string, dst string, type string"), 2, 6, CAPS, BONUS, EDGE)
    assert got.count() == n * 5 and max(met) <= n * 12, met


def test_candidates_match_a_loop(spark, made):
    nodes, edges, n, e = made
    types, ids = {i: (t, d) for i, _, t, d in nodes}, [f"n{i:02d}" for i in range(12)]
    edges = edges + [("n01", "n01", "x"), ("n02", "n30", "y"), ("n02", "n30", "x")]
    want = {}
    for s, d, k in edges:
        if s in ids and d != s:
            score = BONUS.get(types[d][0], 0.4) + EDGE.get(k, 0.0) + (0.8 if types[d][1] else 0) + 1.8 - (0.35 if types[d][0] == types[s][0] else 0)
            want[s, d] = max(want.get((s, d), -99), round(score, 9))
    e = spark.createDataFrame(edges, "src string, dst string, type string")
    got = graph.candidates(spark.createDataFrame([(i, i) for i in [*ids, "unknown"]], "seed string, id string"), n, e, len(edges), BONUS, EDGE)
    assert sorted(((r.seed, r.id), r.score) for r in got.collect()) == sorted(want.items())


def test_candidates_are_scored_in_tasks_of_bounded_size(spark, sf, monkeypatch):
    make = catalog.QUERIES["kg_candidate_scores"]
    want = sorted(map(tuple, make(spark, sf).collect()))
    monkeypatch.setattr(graph, "TASK_ROWS", 300, raising=False)
    got = make(spark, sf)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == want
    for df in (got, catalog.kg_base_edges(spark, sf)):  # the edges of all kg queries are made in such tasks as well
        most = df.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0]
        assert most <= 900 < len(want), most
