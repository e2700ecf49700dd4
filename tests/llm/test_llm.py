"""The training-data operators against brute force, on small fixtures with nulls, ties, repeats, and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixspark.llm import ann, bpe, dedup, mixing, packing, pii, quality, registry, sharding, shared, textkit, tokens, topk, vectors, warc
from helixspark.llm.components import components

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, kept string"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def document(i, text, source="a", lang="en"):
    return (i, text, lang, source, len(text or ""), "x", "y", "z")


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7))) for _ in range(60)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 90))) for _ in range(60)]
    rows = [document(i, t, rnd.choice(["a", "b", None, "𐀀", "～"])) for i, t in enumerate(texts)]
    rows += [document(100 + i, texts[i % 5] + (" tail" if i % 2 else "")) for i in range(20)]
    rows += [document(200, None), document(201, ""), document(202, " \n\t"), document(None, texts[3]), rows[4], document(203, "one"), document(204, "ONE"), document(205, "x" * 20000), document(206, " ".join(words * 200))]
    rows += [document(207, "mail a@b.c-d_e@f.g and +1 (656) 555-6510, 1.2.3.4.5.6.7.8, 300.1.1.1, 4111 1111 1111 1111 é𐀀 4111111111111112"), document(208, 'token = "0641917ea4e9feb9cda83477b57ac2654884f485" x')]
    return spark.createDataFrame(rows, DOCS)


def texts_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_token_counts_match_the_library(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    want = sorted((i if i is not None else -1, len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 50) for i, x in texts_of(docs))
    got = tokens.count_tokens(docs, WORD, limit=50)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want
    assert tokens.count_tokens(docs.limit(0), WORD).count() == 0


def test_encoders_on_odd_text():
    from tokenizers import Tokenizer

    rnd = random.Random(5)
    letters = " '\n\t\u0085　strevmld aAÉéeΣσİǅ①9٣½!?.-_̸́<>|中ß𝔸🙂ﬁ"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + ["<|endoftext|>a b<|endoftext|>", "x<|startoftext|> y", "aaaaaaaaa", "'s't're'rest 's"]
    a, b = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    ids, offsets = bpe.byte_encoder(BYTE).encode(texts)
    assert [ids[x:y].tolist() for x, y in zip(offsets[:-1], offsets[1:], strict=True)] == [e.ids for e in a.encode_batch(texts, add_special_tokens=False)]
    assert bpe.word_counter(WORD).count(texts).tolist() == [len(e.ids) for e in b.encode_batch(texts, add_special_tokens=False)]


def test_packing(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE)
    rows = packing.pack(docs, BYTE, window=64, open_windows=3, group=5).collect()
    want = sorted(([*t.encode(x, add_special_tokens=False).ids, 0] for _, x in texts_of(docs)), key=len)
    by_place: dict = {}
    for r in rows:
        assert 0 < r.length <= 64 and len(r.ids) == 4 * r.length
        by_place.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_place.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(r.length for r in rows) == sum(map(len, want))
    one = sorted((r for r in rows if r.doc_id == 206), key=lambda r: r.start)
    assert np.frombuffer(b"".join(r.ids for r in one), "<u4").tolist() == next(w for w in want if len(w) == one[0].doc_tokens)
    assert packing.pack(docs.limit(0), BYTE).count() == 0


def test_pieces_have_the_crc_of_their_ids(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE)
    ids = {r.doc_id: np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = registry.QUERIES["op3_pack"](spark, sf).collect()
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id]) for r in rows)
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))


def test_mixing(docs):
    rows = mixing.mix_sources(docs, cell_rows=7).collect()
    sizes: dict = {}
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and r.taken <= 2 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        goal = {s: 2 * sizes[s] if s in full else weight[s] * left / sum(weight[x] for x in names if x not in full) for s in names}
        more = {s for s in names if goal[s] > 2 * sizes[s]} | full
        if more == full:
            break
        full = more
    for s in names:
        own = [r for r in rows if r.source == s]
        assert own[0].target == pytest.approx(goal[s]) and abs(sum(r.taken for r in own) - goal[s]) <= 1
    again = mixing.mix_sources(docs.repartition(5), cell_rows=7).collect()
    assert sorted((r.doc_id or -1, r.taken) for r in again) == sorted((r.doc_id or -1, r.taken) for r in rows)
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.repeat_taken(mixing.mix_sources(docs)).where("doc_id = 201").count() == 1


def test_sharding(spark, docs):
    rows = sharding.shard(docs, shards=5, cell_rows=7, keep=("kept",)).collect()
    want = sorted((i or -1, len(x.encode()) + 16) for i, x in texts_of(docs))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size) for r in rows) == sorted((i if i is not None else -1, len(x.encode()) + 16) for i, x in texts_of(docs)) and len(want) == len(rows)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    same = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("hot").alias("text"))
    sizes = [r[1] for r in sharding.shard(same, shards=8, cell_rows=50).groupBy("shard").agg(F.sum("size")).collect()]
    crc = {(r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in rows}
    assert crc == {(r.doc_id, len((r.text or "").encode()) + 16, None if r.text is None else zlib.crc32(r.text.encode()), "bytes", None) for r in docs.collect()}
    few = sharding.shard(spark.range(3).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), shards=8).collect()
    assert sorted(r.doc_id for r in few) == [0, 1, 2] and len({(r.shard, r.slot) for r in few}) == 3
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 0.02 * sum(sizes) / 8 + 40
    assert sharding.shard(docs.limit(0)).count() == 0


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def test_shingles_are_those_of_the_words(monkeypatch):
    rnd = random.Random(12)
    texts = ["".join(rnd.choice("aAbBé𐀀 \t\n\x0b\x0c\r\u00a0\u2003") for _ in range(rnd.randint(0, 40))) for _ in range(400)] + [None, "", " ", "x" * 5000 + " y z w"]
    whole = textkit.shingle_hashes(pa.array(texts).slice(3), 3)
    monkeypatch.setattr(textkit, "CHUNK", 64)
    h, offsets = textkit.shingle_hashes(pa.array(texts).slice(3), 3)
    assert (h == whole[0]).all() and (offsets == whole[1]).all()
    names: dict = {}
    for i, t in enumerate(texts[3:]):
        want, own = shingles(t, 3), h[offsets[i] : offsets[i + 1]].tolist()
        assert len(own) == len(want) == len(set(own)) and own == sorted(own)
        names[want] = names.get(want, own)
        assert names[want] == own
    single = {next(iter(w)): o[0] for w, o in names.items() if len(w) == 1}
    assert len(set(single.values())) == len(single)


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, k, percent):
    rnd = random.Random(9)
    base = [f"w{rnd.randint(0, 10**6)}" for _ in range(120)]
    near = []
    for i in range(80):
        w = list(base)
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(len(w))] = f"v{rnd.randint(0, 10**6)}"
        near.append(document(1000 + i, " ".join(w)))
    pair = "p q r s t u v w x y z a b c d e f g h i j k l"
    own = [document(None, pair), document(None, pair), document(900, pair + " m"), document(7, base[0]), document(None, "quite alone here now then"), document(901, "the same"), document(902, "the  same")]
    every = docs.unionByName(spark.createDataFrame(near + own, DOCS))
    want = brute_components(texts_of(every), k, percent)
    order = lambda r: tuple(-1 if x is None else x for x in r)
    rows = dedup.near_duplicates(every, k, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows), key=order) == sorted(want, key=order)
    assert dedup.near_duplicates(docs.limit(0), k, percent).count() == 0


def brute_components(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    comp = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and comp[i] != comp[j] and 100 * len(x & y) >= percent * len(x | y):
                comp = [comp[j] if c == comp[i] else c for c in comp]
    least = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in set(comp)}
    return [(r[0], len(x), least[c], r[0] == least[c]) for r, x, c in zip(rows, sets, comp, strict=True)]


def test_blocks_of_a_bucket_join_all_that_is_linked(spark, monkeypatch):
    """Texts that differ from each other by up to a third: many stay apart, so buckets are open and are cut in blocks."""
    monkeypatch.setattr(dedup, "BLOCK", 20)
    rnd = random.Random(21)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.randint(0, 9)):
            w[rnd.randrange(len(w))] = f"v{rnd.randint(0, 30)}"
        rows.append(document(i, " ".join(w)))
    want = brute_components([(r[0], r[1]) for r in rows], 3, 85)
    got = dedup.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(7), 3, 85).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == set(want) and 1 < len({r.component_id for r in got}) < 150


def test_rows_sent_to_blocks_grow_with_a_group_not_with_its_square(spark, monkeypatch):
    """Texts with one odd word are near all others, those with two aren't near each other; the first ones, that others meet first, have two."""
    sent, candidates = spark.sparkContext.accumulator(0), dedup._candidates
    members = []

    class Spy(dedup.Stage):
        def __init__(self, df, name, *more):
            super().__init__(df, name, *more)
            if name == "open":
                members.append(self.df.count())

    def counted(*args):
        run = candidates(*args)

        def count(few, many):
            sent.add(few.num_rows + many.num_rows)
            return run(few, many)

        return count

    monkeypatch.setattr(dedup, "Stage", Spy)
    monkeypatch.setattr(dedup, "_candidates", counted)
    monkeypatch.setattr(dedup, "BLOCK", 10)
    rows = []
    for i in range(160):
        w = [f"w{j}" for j in range(100)]
        for j in [(7 * i) % 47, 50 + (11 * i) % 43][: 2 if i < 110 else 1]:
            w[j] = f"v{i}"
        rows.append(document(i, " ".join(w)))
    want = brute_components([(r[0], r[1]) for r in rows], 5, 70)
    got = dedup.near_duplicates(spark.createDataFrame(rows, DOCS), 5, 70).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == set(want)
    assert members[0] > 500 and 0 < sent.value < 3 * members[0], (sent.value, members)


def test_small_sets_share_no_band_by_one_common_shingle():
    rnd = np.random.default_rng(4)
    common = rnd.integers(1, 1 << 62, 1, dtype=np.uint64)
    sets = [np.sort(np.concatenate((common, rnd.integers(1, 1 << 62, 40, dtype=np.uint64)))) for _ in range(300)]
    r = dedup.registers(np.concatenate(sets), np.arange(301) * 41)
    keys = dedup.band_keys(r)
    assert max(Counter(keys.ravel().tolist()).values()) < 5 and (dedup.filled(r) != dedup.EMPTY).all()
    one = dedup.filled(dedup.registers(sets[0][:1], np.array([0, 1])))
    assert len(np.unique(one)) == 1


def test_pairs_at_the_threshold_are_missed_rarely():
    for x, most in ((0.8, 3e-6), (0.85, 3e-9)):
        assert (1 - x**dedup.WIDTH) ** dedup.BANDS < most
        assert x - dedup.floor_of(x) > 5.99 * (x * (1 - x) / dedup.REGISTERS) ** 0.5


def test_register_estimates():
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 1 << 63, 2000, np.uint64)
    a, b = np.sort(x[:1600]), np.sort(x[400:])
    r = dedup.registers(np.concatenate((a, b)), np.array([0, 1600, 3200]))
    assert abs(dedup.estimate(r[0], r[1]) - 0.6) < 0.1


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(100, 3), (100, 25), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert {got[i] for i in [*range(10), *range(20, 30), 100]} == {0} and {got[i] for i in range(10, 20)} == {10}
    rnd = random.Random(8)
    places = rnd.sample(range(10**6), 700)
    chain = spark.createDataFrame(list(zip(places, places[1:], strict=False)), "a long, b long")
    assert {r.component for r in components(chain).collect()} == {min(places)}
    assert components(links.limit(0)).count() == 0


def vector_rows(n=700, d=16, seed=2):
    rnd = np.random.default_rng(seed)
    x = rnd.standard_normal((n, d)).astype(np.float32)
    x[50:120] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(2000, None), (2001, []), (2002, [float("nan")] * d), (2003, [None] * d), (2004, [0.0] * d), (None, x[0].tolist()), (2050, [1.0, 2.0]), (2100, [2.0, 4.0]), (3, x[3].tolist())]
    return rows + odd, x


def test_nearest_vectors(spark):
    rows, x = vector_rows()
    table = spark.createDataFrame([(*r, "q") for r in rows], "vec_id long, embedding array<float>, rank string")
    got: dict = {}
    for r in ann.nearest(table, F.col("id") % 50 == 0, cell_rows=100, block_rows=60, query_rows=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    hit = 0
    for q in range(0, 700, 50):
        s = u @ u[q]
        s[q] = -9
        best = np.lexsort((np.arange(700), -s.round(12)))[:5]
        hit += len({v for _, v, _ in got[q]} & set(best.tolist()))
        assert [k for k, _, _ in sorted(got[q])] == [1, 2, 3, 4, 5]
    assert hit >= 0.9 * 5 * 14
    assert [v for _, v, _ in sorted(got[100])] == [50, 51, 52, 53, 54]
    assert got[2050] == [(1, 2100, pytest.approx(1.0))]
    assert ann.nearest(table.limit(0), F.col("id") % 50 == 0).count() == 0


def test_the_stop_stops_and_finds(spark):
    rnd = np.random.default_rng(1)
    near = np.repeat(rnd.standard_normal((40, 64)), 100, axis=0) + rnd.standard_normal((4000, 64)) * 0.05
    for x, most in ((near, 0.1), (rnd.standard_normal((2000, 64)), 0.9)):
        u = ann._unit(x)
        ids = np.arange(len(u))
        asked = ids % 50 == 0
        best = vectors.Best(ids[asked], 5)
        assert ann.verify(u[asked], u, ids, best, 16, 0.98, 11) < most
        cos = u[asked] @ u.T
        cos[np.arange(len(cos)), ids[asked]] = -2
        assert (best.score >= np.sort(cos, axis=1)[:, -5:-4] - 1e-12).mean() > 0.95


def test_projected_cells_hold_their_points():
    rnd = np.random.default_rng(3)
    x, q = rnd.standard_normal((500, 4)), rnd.standard_normal((40, 4))
    tree = ann.KdTree(x[:200], 4)
    cells, gaps = tree.cells(x), tree.distances(q)
    exact = ((q[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    assert set(cells) <= set(range(16)) and (gaps[:, cells] <= exact + 1e-9).all() and (gaps[np.arange(40), tree.cells(q)] == 0).all()
    same = ann.KdTree(np.ones((40, 4)), 2)
    assert set(same.cells(np.ones((5, 4)))) == {3} and abs(ann.chi_square(ann.reach_of(0.9, 8), 8) - 0.9) < 1e-9


def test_top_products_are_exact(spark):
    rows, x = vector_rows()
    whole = np.floor(x.astype(np.float64) * 256).astype(np.int64)
    table = spark.createDataFrame([(i, None if v is None or any(c is None or c != c for c in v) else [int(np.floor(np.float64(np.float32(c)) * 256)) for c in v]) for i, v in rows], "vec_id long, vector array<long>")
    got: dict = {}
    for r in topk.top_products(table, F.col("id") % 50 == 0, block_rows=150, query_rows=6).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    data = np.vstack([whole, np.zeros((1, 16), np.int64)])
    ids = np.array([*range(700), 2004])
    for q in range(0, 700, 50):
        s = data @ whole[q]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:5]
        assert sorted(got[q]) == [(k + 1, int(ids[j]), int(s[j])) for k, j in enumerate(order)]
    large = spark.createDataFrame([(0, [1 << 40, 1]), (1, [1 << 20, 3]), (2, [5, 1]), (3, [1 << 30, 0]), (4, [-(1 << 30), 0])], "vec_id long, vector array<long>")
    got = topk.top_products(large, F.col("id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(3, topk.TOP), (1, (1 << 60) + 3), (2, 5 * (1 << 40) + 1), (4, -topk.TOP)]


def test_dual_trees_are_exact_and_prune():
    rnd = np.random.default_rng(0)
    centres = rnd.standard_normal((40, 64))
    clusters = np.floor((np.repeat(centres, 100, axis=0) + rnd.standard_normal((4000, 64)) * 0.05) * 256)
    ties = rnd.integers(-2, 3, (900, 4))
    wide = rnd.integers(-(2**30), 2**30, (300, 3))
    for x, most in ((clusters.astype(np.int64), 0.1), (ties, 1.01), (wide, 1.01), (np.ones((70, 5), np.int64), 1.01)):
        ids = rnd.permutation(len(x))
        asked = ids % 50 == 0
        best = vectors.Best(ids[asked], 5, np.int64)
        share = topk.dual_search(x[asked], x, ids, best)
        assert share < most
        for q, i, s in zip(np.flatnonzero(asked), best.id, best.score, strict=True):
            own = sum(x[:, d].astype(object) * int(x[q, d]) for d in range(x.shape[1]))
            order = [j for j in sorted(range(len(x)), key=lambda j: (-own[j], ids[j])) if j != q][:5]
            assert list(zip(i.tolist(), s.tolist(), strict=True)) == [(int(ids[j]), own[j]) for j in order]


def test_archives(spark, tmp_path):
    body = "x" * 150
    rows = [(1, "http://a.b.com/p?q=1", body, 7), (2, "http://b.com/", body, 7), (0, None, body, 7), (3, "http://[bad", "short", 7), (4, "http://b.com/", "short", 7), (5, "http://b.com/\tz", None, 7), (None, "http://c.org", "y" * 200, 7), (6, "http://c.org", "é" * 70000, 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    archive = warc.write(pages, f"file://{tmp_path}/w", block_lines=3)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in archive.records().collect()}
    data = {r[0]: (r[2] or "").encode() for r in rows}
    want = {i: (len(b), hashlib.sha256(b).hexdigest(), "revisit" if b == body.encode() and i != 0 else "response", 0 if b == body.encode() and i != 0 else None) for i, b in data.items()}
    assert got == want
    found = archive.lookup(spark.createDataFrame([("http://B.com/",), ("http://none.org/",)], "url string")).collect()
    assert {r.page_id for r in found} == {2, 4} and {r.url_key for r in found} == {"com,b)/"}
    assert warc.write(pages.limit(0), f"file://{tmp_path}/e").records().count() == 0
    assert warc.url_key("https://www.B.example.com:80/X?y") == "com,example,b:80)/x?y"


def brute_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m)
    luhn = lambda s: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(s[::-1])) % 10 == 0
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))), ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15)]
    return [(k, m.start(), m.end()) for k, x, ok in kinds for m in re.finditer(x, t) if ok(m.group())]


def test_personal_data(spark, docs):
    odd = [document(300, "1.2.3.4 " * 900), document(301, "a@b.c" * 30 + "@x.y"), document(302, "9" * 9000), document(303, "+1 (23" * 40 + " 456-7890"), document(304, "0001.002.3.255 1-2-3 4 5 6 7 8 9 0 1 2 3 +49 30 123456"), document(305, "x" * 9000 + "@y.z")]
    every = docs.unionByName(spark.createDataFrame(odd, DOCS))
    names = pii.KINDS
    for r in pii.find_spans(every).collect():
        assert [(names[s.kind], s.s, s.e) for s in r.pii_spans if names[s.kind] in pii.BASE] == brute_spans(r.text or "")
    masked = {r.doc_id: r.text for r in pii.redact(pii.find_spans(docs)).collect()}
    assert masked[207].startswith("mail <EMAIL><EMAIL> and <PHONE>, <IP>.<IP>, 300.1.1.1, <CARD> é𐀀 4111111111111112") and masked[200] is None
    assert pii.find_spans(docs.limit(0)).count() == 0


def test_overlapping_spans_are_masked_whole(spark):
    rows = [(1, "see card-no-4111 1111 1111 1111 now", [(4, 4, 16), (2, 12, 31)]), (2, "/user12345678@mail.com!", [(4, 0, 13), (0, 1, 22)]), (3, "abcdef", [(0, 0, 5), (1, 1, 3), (2, 4, 6)]), (4, "abcdef", [(0, 0, 3), (1, 3, 6)])]
    found = spark.createDataFrame(rows, "doc_id long, text string, pii_spans array<struct<kind int, s long, e long>>")
    assert {r.doc_id: r.text for r in pii.redact(found).collect()} == {1: "see <SECRET> now", 2: "<SECRET>!", 3: "<EMAIL>", 4: "<EMAIL><IP>"}


def test_credentials_are_learned(spark):
    rnd = random.Random(4)
    h = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f'the words of it token = "{h(40)}" and on' if i % 3 == 0 else f"we had password={h(12)} for it" if i % 3 == 1 else f"in room a{i}00000000 and 20{i:02}1231 there") for i in range(90)]
    got = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.size("pii_spans").alias("n")).collect()
    assert all((r.n > 0) == (r.doc_id % 3 < 2) for r in got)
    # the first digit may come late, and helper columns don't meet the table's own
    late = [(i, f'token = "{"abcdefghij" * 9}{h(8)}1" x', "a", [1]) for i in range(20)] + [(100 + i, "plain words only", "b", [2]) for i in range(5)]
    found = pii.find_spans(spark.createDataFrame(late, "doc_id long, text string, _text string, __secret array<int>"))
    assert found.columns == ["doc_id", "text", "_text", "__secret", "pii_spans"]
    for r in found.collect():
        assert [(s.kind, s.s, s.e) for s in r.pii_spans] == ([(4, 9, len(r.text) - 3)] if r.doc_id < 100 else []) and r["_text"] == ("a" if r.doc_id < 100 else "b")


def test_quality(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice(["an", "the", "on", "re", "ti"]) for _ in range(rnd.randint(1, 4)))
    good = [" ".join(word() for _ in range(60)) for _ in range(200)]
    rows = [document(i, t) for i, t in enumerate(good)] + [document(500 + i, good[i].upper() + "!!") for i in range(10)] + [document(600, None), document(601, ""), document(602, "other", lang=None), document(None, good[0])]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(501, 0, 0), (None, 1, 0), (5, 1, None)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, DOCS)
    out = quality.classify(docs, labels).collect()
    kept = {r.doc_id: r.kept for r in out}
    assert len(out) == len(rows) and not any(kept[500 + i] for i in range(10)) and sum(kept[i] for i in range(200)) >= 195 and kept[600] and kept[601]
    assert all(r.kept for r in quality.classify(docs, labels.limit(0)).collect())
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_model_sums_to_one(spark):
    letters = quality.Symbols([ord(c) for c in "abcx"])
    key = lambda s: int(quality.windows([s], letters)[0][-1])
    counts = spark.createDataFrame([(key(s), n) for s, n in [("abcab", 3), ("bcabc", 1), ("abcac", 2), ("xxxab", 4), ("cabca", 1)]], "gram long, n long")
    contexts = ["abca", "bcab", "zzca", "zzzz"]
    grams = spark.createDataFrame([(key(c + x),) for c in contexts for x in "abc?"], "gram long")
    p = {r.gram: r.p for r in quality.probabilities(quality.estimate(counts, []), grams, []).collect()}
    assert all(abs(sum(p[key(c + x)] for x in "abc?") - 1) < 1e-9 for c in contexts)
    assert p[key("abcab")] > p[key("abcaa")] > 0 and p[key("zzzz?")] > 0


def test_grams_of_parts_add_up():
    texts = ["", "abcabc", "é\U0001f600a", "abcabcabc"]
    symbols = quality.Symbols([ord("b"), 0x1F600, ord("a")])
    seen = quality.Grams(symbols)
    for t in texts:
        seen.add([t])
    code = lambda c: {"b": 2, "\U0001f600": 3, "a": 4}.get(c, 1)
    number = lambda g: sum(x << (12 * (4 - i)) for i, x in enumerate(g))
    want = Counter(number(([0] * 4 + list(map(code, t)))[i : i + 5]) for t in texts for i in range(len(t)))
    assert dict(zip(seen.grams.tolist(), seen.n.tolist(), strict=True)) == want


def kneser_ney(texts):
    """Interpolated modified Kneser-Ney over characters by hand: the probability of the last of five."""
    pad = lambda t: [None] * 4 + list(t)
    level = Counter(tuple(pad(t)[i : i + 5]) for t in texts for i in range(len(t)))
    levels = {}
    for order in range(5, 0, -1):
        cc = Counter(level.values())
        n1, n2, n3, n4 = (cc[i] or 1 for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [min(max(x, 0.05), i * 0.95) for i, x in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]
        total, free = Counter(), Counter()
        for g, n in level.items():
            total[g[:-1]] += n
            free[g[:-1]] += d[min(n, 3) - 1]
        levels[order] = (level, d, total, free)
        level = Counter(g[1:] for g in level)

    def p(g):
        level, d, total, free = levels[len(g)]
        n, t = level[g], total[g[:-1]]
        own = (n - d[min(n, 3) - 1]) / t if n else 0.0
        if len(g) == 1:
            return own + free[()] / t / (len(level) + 1)
        return own + (free[g[:-1]] / t if t else 1.0) * p(g[1:])

    return lambda t: np.exp(-np.mean([np.log(p(tuple(pad(t)[i : i + 5]))) for i in range(len(t))]))


def test_perplexities_are_those_of_the_model(spark):
    rnd = random.Random(16)
    letters = "abcde 漢字仮名交\U0001f600é"
    texts = ["".join(rnd.choices(letters, range(len(letters), 0, -1), k=rnd.randint(1, 80))) for _ in range(40)] + ["語界语", "\U0001f601\U0001f602", "漢界", "zzzz"]
    docs = spark.createDataFrame([document(i, t) for i, t in enumerate(texts)], DOCS)
    want = kneser_ney(texts[:25])
    got = quality.perplexities(docs, spark.range(25).select(F.col("id").alias("doc_id"))).collect()
    assert len(got) == len(texts) and all(r.perplexity == pytest.approx(want(texts[r.doc_id]), rel=1e-4) for r in got)


def test_filter_keeps_every_id(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).unionByName(spark.createDataFrame([(None, "x")], "doc_id long, text string"))
    got = {r.doc_id for r in shared.likely(rows, rows.where("doc_id % 7 = 0").select("doc_id"), "doc_id").collect()}
    assert got >= set(range(0, 3000, 7)) and None not in got and len(got) < 1000


def test_blocks_cut_within_partitions_score_alike(spark, docs, monkeypatch):
    trusted = docs.where("doc_id < 30").select("doc_id").distinct()
    whole = sorted(map(str, quality.perplexities(docs, trusted).collect()))
    monkeypatch.setattr(quality, "BLOCK", 500)
    assert sorted(map(str, quality.perplexities(docs, trusted).collect())) == whole


def test_pipeline_and_registry(spark, sf):
    import corpus_pipeline

    docs, sizes = spark.read.parquet(f"{sf}/documents.parquet"), []
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = docs.sparkSession.createDataFrame(stage(spark, docs, sf).toPandas(), docs.schema)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert 200 > sizes[0] > sizes[1] == sizes[2] and sizes[3] > 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
