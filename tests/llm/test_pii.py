"""What labelers see of a candidate's surroundings, and planted credentials of several forms."""

import random
import re

import pytest
from pyspark.sql import functions as F

pii = pytest.importorskip("helixspark.llm.pii")


def test_context_reaches_over_earlier_candidates(spark):
    texts = ["password1234: s3cr3tvalue99", "aaaaaaa1 bbbbbbb2 ccccccc3 ddddddd4 eeeeeee5", "x" * 50 + " abcdefg1", "abcdefg1", "a1b2c3d4é𐀀 \nABCDEFG7.", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, _text string")
    rows = pii._found(df, "secret", pii.EXTRA["secret"], F.lit(True), "_", True).orderBy("i").collect()
    for r, t in zip(rows, texts, strict=True):
        want = [(m.start(), m.end(), m.group(), t[max(0, m.start() - pii.CONTEXT) : m.start()].lower(), t[m.end() : m.end() + 2]) for m in re.finditer(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{8,}", t or "")]
        assert [(c.s, c.e, c.v, c.l, c.r) for c in r["_secret"] or []] == want
    assert rows[0]["_secret"][1].l == "password1234: "


def test_planted_credentials_precision_and_recall(spark):
    rnd = random.Random(7)
    word = lambda n, letters="abcdefghijklmnopqrstuvwxyz": "".join(rnd.choice(letters) for _ in range(n))
    code = lambda n: word(n, "0123456789abcdef")
    rows, planted = [], {}
    for i in range(400):
        prose = " ".join(word(rnd.randint(2, 8)) for _ in range(30))
        kind = i % 8
        secret = code(40) if kind < 2 else code(24)
        lead = {0: 'token = "', 1: "api_key: ", 2: "password1234: ", 3: "secret="}.get(kind)
        if lead:
            rows.append((i, f"{prose} {lead}{secret}{'"' if kind == 0 else ''} {prose}"))
            at = rows[-1][1].index(secret)
            planted[i] = (at, at + len(secret))
        else:
            rows.append((i, f"{prose} in {word(8)}{rnd.randint(1, 9)} {rnd.randint(10**8, 10**9)} {prose}"))
    got = {r.doc_id: {(s.s, s.e) for s in r.pii_spans if s.kind == len(pii.BASE)} for r in pii.find_spans(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    hits = sum(planted[i] in got[i] for i in planted)
    found = sum(map(len, got.values()))
    assert hits >= 0.95 * len(planted) and hits >= 0.75 * found, (hits, len(planted), found)
