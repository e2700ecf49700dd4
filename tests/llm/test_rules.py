"""Quality rules: counts against brute force, and the fitted model against planted documents."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

rules = pytest.importorskip("helixspark.llm.rules")
SCHEMA = "doc_id long, text string, n_words string, _counts string, kept string"


def counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefé𐀀") for _ in range(rnd.randint(2, 9))) for _ in range(400)]
    prose = lambda n: "\n".join(" ".join(rnd.choice(words) for _ in range(12)) + "." for _ in range(n))
    good = [prose(rnd.randint(6, 30)) for _ in range(120)]
    junk = [" ".join(w + rnd.choice(["###", "$$$", "&&&"]) for w in prose(10).split()) for _ in range(12)]
    junk += [prose(10).upper().replace(" ", "!! ") for _ in range(12)]
    junk += [" | ".join(prose(10).split()) for _ in range(12)]
    odd = [None, "", " \n\t", "one", "a b c a b c", "a a a a", "x y z " * 40, ("n o p q\n" * 3 + "\n \n") * 2, "a\x0bb\x1cc\x85d", "long " + "x" * 50000, " ".join(words * 30), good[0], good[0]]
    return good, junk, odd


def frame(spark, texts):
    return spark.createDataFrame([(i if i % 11 else None, t, "x", "y", "z") for i, t in enumerate(texts)], SCHEMA)


def test_counts(spark, texts):
    every = [t for part in texts for t in part]
    got = rules.measure(frame(spark, every)).collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got] == [counts(t) for t in every]


def test_planted_junk_goes_and_prose_stays(spark, texts):
    good, junk, odd = texts
    got = rules.judge_documents(frame(spark, good + junk + odd))
    assert {"doc_id", "text", "_counts", "p_good"} <= set(got.columns) and got.count() == len(good + junk + odd)
    kept = {(r.text, r.kept) for r in got.select("text", "kept").collect()}
    assert all((t, True) in kept for t in good if not counts(t)[-1])
    assert all((t, False) in kept for t in junk)
    assert not any(k for t, k in kept if counts(t)[-1])


def test_objections_never_speak_for_a_document(spark, texts):
    prior, odds = rules.fit(rules.measure(frame(spark, texts[0] + texts[1])))
    assert all(o[0] < 0 <= o[2] for o in odds) and len(odds) == len(rules.RULES)


def test_empty_and_all_alike(spark):
    assert rules.judge_documents(frame(spark, [])).count() == 0
    one = " ".join(f"word{i}" for i in range(80)) + "."
    assert [r.kept for r in rules.judge_documents(frame(spark, [one] * 5)).collect()] == [True] * 5


def test_main_path_has_no_python(spark, texts):
    plan = rules.judge_documents(frame(spark, texts[2]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_quality_against_labels(spark):
    """Documents whose labels the model hasn't seen: clean ones that pass the base stay, low-quality ones go."""
    sf = "/root/testdata/sf0.01"
    judged = rules.judge_documents(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), keep_text=False)
    rows = judged.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where(~F.col("base_failed")).groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in rows}
    assert n[1, True] >= 0.99 * (n[1, True] + n.get((1, False), 0)) and n[0, False] >= 0.95 * (n[0, False] + n.get((0, True), 0))
