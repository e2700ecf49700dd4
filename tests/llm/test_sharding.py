"""Shards against the contract, with groups of equal texts of all sizes, and cuts against brute force."""

import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

sharding = pytest.importorskip("helixspark.llm.sharding")


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


def shards_of(rows, shards):
    groups, sizes = defaultdict(set), [0] * shards
    slots = defaultdict(list)
    for r in rows:
        groups[r.text_crc32].add(r.shard)
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return groups, sizes


def test_groups_that_fit_stay_whole_and_shards_level(spark):
    rnd = random.Random(1)
    singles = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(10, 60))) for _ in range(3000)]
    copies = [("c%d " % k) * 20 for k, n in enumerate((2, 5, 9, 20, 33, 40)) for _ in range(n)]
    texts = singles + copies + [None] * 7 + [""] * 3
    rows = sharding.shard(frame(spark, texts), shards=10).collect()
    groups, sizes = shards_of(rows, 10)
    assert all(len(s) == 1 for s in groups.values())  # null texts are one group as well
    mean = sum(sizes) / 10
    assert max(abs(s - mean) for s in sizes) < 0.06 * mean
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == [(i, len((t or "").encode()) + 16, zlib.crc32(t.encode()) if t is not None else None) for i, t in enumerate(texts)]


def test_only_a_group_beyond_a_shard_is_cut(spark):
    texts = ["same text " * 3] * 900 + ["other " * 5] * 60 + [f"text number {i}" for i in range(600)]
    groups, sizes = shards_of(sharding.shard(frame(spark, texts), shards=8).collect(), 8)
    cut = {c for c, s in groups.items() if len(s) > 1}
    assert cut == {zlib.crc32(texts[0].encode())}
    mean = sum(sizes) / 8
    assert max(abs(s - mean) for s in sizes) < 0.06 * mean


def test_splitters_match_a_brute_force_cut(spark):
    rnd = random.Random(5)
    rows = [(rnd.getrandbits(64) - (1 << 63), rnd.getrandbits(64) - (1 << 63), rnd.randint(16, 900)) for _ in range(800)]
    rows += [(rows[0][0], rnd.getrandbits(63), 400) for _ in range(200)]  # one high word that has to be cut
    keys = spark.createDataFrame(rows, "hi long, lo long, size long")
    total = sum(r[2] for r in rows)
    goals = [total * k // 7 for k in range(1, 7)]
    edges = sharding.splitters(keys, total, len(rows), goals, total // 700, 0, 8)
    word = lambda x: x % (1 << 64)
    below = lambda e: sum(s for hi, lo, s in rows if (word(hi) << 64) + word(lo) < e)
    assert edges == sorted(edges) and all(abs(below(e) - g) <= max(total // 700, 900) for e, g in zip(edges, goals, strict=True))


def test_fill_is_level():
    where, share = sharding.fill([0] * 4, [(1, 50), (2, 30), (3, 30), (4, 10)], 400)
    assert where == {1: 0, 2: 1, 3: 2, 4: 3} and share == [50, 70, 70, 90]
    where, share = sharding.fill([0] * 3, [(1, 90)], 100)
    assert share[where[1]] == 0 and sorted(share) == [0, 5, 5]
    assert sharding.fill([0] * 2, [], 0) == ({}, [0, 0])


def test_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.shard(docs).select("shard", "size", "text_crc32", "slot", F.lit(0).alias("x")).collect()
    groups, sizes = shards_of(rows, 40)
    limit = sum(sizes) / 40
    by_group = defaultdict(int)
    for r in rows:
        by_group[r.text_crc32] += r.size
    assert all(len(s) == 1 for c, s in groups.items() if by_group[c] <= limit)
    assert 0.9 < min(sizes) / limit and max(sizes) / limit < 1.1, (min(sizes) / limit, max(sizes) / limit)
