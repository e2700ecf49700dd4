"""Vector codes against brute force."""

import math

import numpy as np
import pytest

codes = pytest.importorskip("helixspark.llm.codes")
SCHEMA = "vec_id long, embedding array<double>, label string, code string, error string"


def by_hand(rows, entries=6, rounds=3, parts=4):
    """The same codebooks and codes with Python's integers, row by row."""
    width = -(-max((len(v) for _, v, _ in rows), default=0) // parts) * parts
    whole = [[math.floor(x * 1024) if abs(x) < 2**52 else int(x) * 1024 for x in v] + [0] * (width - len(v)) for _, v, _ in rows]
    step = width // parts
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    cut = lambda v, p: v[p * step : (p + 1) * step]
    books = [[cut(whole[i], p) for i in order] for p in range(parts)]
    near = lambda x, b: min((sum((a - c) ** 2 for a, c in zip(x, e)), k) for k, e in enumerate(b))
    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for v in whole:
                got.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, xs in got.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    found = [[near(cut(v, p), books[p]) for p in range(parts)] for v in whole]
    return books, [("".join(f"{k:02x}" for _, k in f), min(sum(d for d, _ in f), 2**63 - 1)) for f in found]


def check(spark, rows, dropped=(), **options):
    books, want = by_hand(rows, **options)
    df = spark.createDataFrame([(*r, "x", "y") for r in [*rows, *dropped]], SCHEMA).repartition(3)
    got, coder = codes.compress(df, entries=options.get("entries", 6), rounds=options.get("rounds", 3))
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert [b.tolist() for b in coder.books] == books
    assert sorted(((r.id, r.label, bytes(r.code).hex(), r.error) for r in got.collect()), key=key) == sorted(((i, lab, c, e) for (i, _, lab), (c, e) in zip(rows, want, strict=True)), key=key)
    return got, coder


def test_codes_match_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.normal(0, 0.1, 8).round(3).tolist(), "abc"[i % 3] if i % 7 else None) for i in range(60)]
    # repeated and null ids, ties, a shorter vector and one of another length
    rows += [rows[5], (5, rows[6][1], "a"), (None, rows[7][1], "b"), (200, [0.5, 0.25], "a"), (201, rows[8][1][:5], None), (202, [], "c")]
    bad = [(300, None, "a"), (301, [None] * 8, "a"), (302, [float("nan")] * 8, "a"), (303, [float("inf")] * 8, "b")]
    got, _ = check(spark, rows, bad)
    summed = {(r.id, r.label): r.label_error for r in codes.total_by_label(got).collect()}
    totals = {}
    for r in got.collect():
        totals[r.label] = totals.get(r.label, 0) + r.error
    assert all(v == totals[label] for (_, label), v in summed.items())
    # with every label broadcast, and with none
    every = lambda share: sorted((str(tuple(r)) for r in codes.total_by_label(got, share=share).collect()))
    assert every(10**6) == every(1) == every(1000) and len(every(1)) == len(rows)


def test_wide_components_are_exact(spark):
    check(spark, [(i, [1e30 * i, -3.5e300, 2.0**60 + i, 0.1, -0.1, 5.0, 1e15, float(i)], "a") for i in range(9)], entries=3)


def test_few_and_no_rows(spark):
    check(spark, [(1, [0.5] * 4, "a"), (2, [0.5] * 4, "a")])
    got, coder = codes.compress(spark.createDataFrame([], SCHEMA))
    assert coder is None and got.count() == 0 and got.columns == ["id", "label", "code", "error"]
    with pytest.raises(ValueError, match="one byte"):
        codes.compress(spark.createDataFrame([], SCHEMA), entries=257)


def test_filter_compares_few_entries_and_finds_the_first_of_equal_ones():
    rng = np.random.default_rng(1)
    centres = rng.integers(-500, 500, (40, 16))
    draw = lambda n: centres[rng.integers(0, 40, n)] + rng.integers(-30, 30, (n, 16))
    entries, x = draw(256), draw(3000)
    entries[77] = entries[3]
    x[:5] = entries[77]
    book = codes.Filtered(entries)
    index, distance = book.nearest(x)
    full = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (index == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all() and (index[:5] == 3).all()
    assert book.compared < 0.1 * book.asked


def test_decode_gives_the_entries(spark):
    df = spark.createDataFrame([(i, [i / 8, -i / 4, 1.0, 2.0], "a", "x", "y") for i in range(5)], SCHEMA)
    got, coder = codes.compress(df)
    rows = codes.decode(got, coder).orderBy("id").collect()
    assert [r.vector for r in rows] == [[i / 8, -i / 4, 1.0, 2.0] for i in range(5)] and all(r.error == 0 for r in rows)
