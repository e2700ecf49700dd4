"""The prefix trie against brute force, with long conversations cut in small pieces."""

import hashlib
import random
import re
import zlib

import pytest

prefixes = pytest.importorskip("helixspark.llm.prefixes")
SCHEMA = "conv_id long, turn long, role string, text string, node string, depth string, part string"


def by_hand(rows, block=20, heads=4):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), text or ""))
    turns = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    full = {}
    for c in turns:
        h, base = zlib.crc32(str(c).encode()) % heads, c - (abs(c) % block if c >= 0 else -(abs(c) % block))
        full[c] = turns.get(base, [])[:h] + turns[c][h:]
    nodes = {}
    for c, t in full.items():
        for d in range(len(t) + 1):
            nodes.setdefault(tuple(t[:d]), []).append(c)
    out = []
    for n, cs in nodes.items():
        below = [m for m in nodes if m[: len(n)] == n]
        kids = lambda m: [x for x in nodes if len(x) == len(m) + 1 and x[: len(m)] == m]
        ends = sorted(c for c in cs if len(full[c]) == len(n))
        saved = sum((len(nodes[m]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", m[-1][1])) for m in below if m)
        out.append((min(cs), len(n), min(nodes[n[:-1]]) if n else None, len(cs), len(kids(n)), sum(not kids(m) for m in below), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def got(df):
    return [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in prefixes.with_digests(prefixes.trie(df)).collect()]


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


def order(rows):
    return sorted(rows, key=lambda r: (r[1], r[0], str(r)))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    out = []
    for c in range(-3, 60):
        if c in (20, 41):
            continue  # no conversation of that name: its block begins with nothing
        out += [(c, i, rnd.choice(["user", "assistant"]), rnd.choice(["a b", "c", "a  b\td", "é"])) for i in range(rnd.randint(1, 5))]
    out += [(100, i, "user", f"w {i // 2}") for i in range(75)] + [(101, i, "user", f"w {i // 2}") for i in range(70)]  # long, and alike at first
    out += [(60, None, None, None), (60, None, "user", "x"), (60, 3, "user", "x"), (60, 3, "user", "x"), (60, 3, "user", "a"), (None, 1, "user", "lost"), (61, 0, "", ""), (62, 0, "user", "one")]
    out += [(120, i, "user", "same") for i in range(9)] + [(140 + c, 0, "user", "hot") for c in range(60)]
    return out


@pytest.mark.parametrize("piece", [4, 64])
def test_trie(spark, rows, monkeypatch, piece):
    monkeypatch.setattr(prefixes, "PIECE", piece)
    assert order(got(table(spark, rows))) == order(by_hand(rows))


def test_nodes_that_many_point_to(spark, rows, monkeypatch):
    monkeypatch.setattr(prefixes, "SHARE", 1)  # none is
    few = [r for r in rows if r[0] is not None and r[0] < 30]
    none = got(table(spark, few))
    monkeypatch.setattr(prefixes, "SHARE", 10**6)  # all are
    assert order(got(table(spark, few))) == order(none) == order(by_hand(few))


def test_turnless_and_empty(spark):
    lone = next(c for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4)  # loses its only turn, and has no block to begin with
    assert got(table(spark, [(lone, 0, "user", "a b")])) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    assert got(table(spark, [])) == []
