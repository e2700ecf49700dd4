"""Quality of documents by rules that vote or abstain, with DataFrame operations only.

Each rule looks at counts of one text and votes good, bad or not at all. Expectation-maximisation over the counts of vote patterns
estimates how often each rule casts which vote on good and on bad documents; a document's posterior probability of being good
then decides, so that one weak objection no longer rejects it and one reliable objection does.

The counts of patterns come from all rows and are at most 3 to the number of rules, whatever the input's size.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixspark.llm.shared import fresh, staged

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: Words in a window whose repetitions are counted.
WINDOW = 3
#: Fewest words, and largest percentage of repeated words, of a document that passes the base check.
LEAST_WORDS, MOST_REPEATED = 50, 50
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_cap_words", "n_letter_words", "n_calls"]
#: A rule's share; where it starts to vote (good at or beyond the first bound, bad at or beyond the second, nothing in between);
#: and the log odds that its objection is given before any document is seen.
RULES: dict[str, tuple[Callable[[Callable[[str], Column]], Column], float, float, float]] = {
    "few_words": (lambda c: c("n_words"), 100, 50, -1),
    "short_words": (lambda c: c("word_chars") / c("n_words"), 4, 2, -1),
    "long_words": (lambda c: c("word_chars") / c("n_words"), 10, 16, -1),
    "symbols": (lambda c: c("n_symbols") / c("n_words"), 0.03, 0.1, -4),
    "duplicate_lines": (lambda c: c("n_dup_lines") / (c("n_lines") + 1), 0.05, 0.3, -4),
    "repeated_words": (lambda c: c("n_repeat_words") / c("n_words"), 0.1, 0.3, -4),
    "unended_lines": (lambda c: (c("n_ended_lines") + 1) / (c("n_lines") + 1), 0.6, 0.1, -1),
    "capitals": (lambda c: c("n_cap_words") / c("n_words"), 0.1, 0.3, -4),
    "without_letters": (lambda c: c("n_letter_words") / c("n_words"), 0.9, 0.7, -4),
    "exclamations": (lambda c: c("n_calls") / c("n_words"), 0.03, 0.1, -4),
}
#: Least and most log odds of a bad vote, of none and of a good one. An objection has to be at least four times as frequent
#: on bad documents; a good vote only says that one fault is absent, and so adds little.
BOUNDS = ((-6.0, -math.log(4)), (-0.1, 0.1), (0.0, 0.1))
#: Log odds of good before any vote, and documents of each class and vote that every rule is taken to have seen, at the start.
START, BEFORE = 1.5, 1.0
ROUNDS = 60


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, wherever the optimiser moves the expression."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeated(words: Column) -> Column:
    """Words in windows that the text holds twice or more.

    Part of each window's hash and its place are one whole number; of these, sorted, neighbours of one hash are candidates, which
    are then sorted by the words themselves. Places have 31 bits, as many as an array can hold.
    """
    neighbours = lambda s, same: F.filter(s, lambda x, j: F.coalesce(same(x, F.get(s, j + 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, j - 1)), F.lit(False)))

    def covered(w: Column) -> Column:
        window = lambda i: [F.get(w, i + k) for k in range(WINDOW)]
        keys = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.shiftleft(F.xxhash64(*window(i)), 31).bitwiseOR(i.cast("long")))
        some = _let(F.sort_array(keys), lambda s: neighbours(s, lambda x, y: F.shiftright(x, 31) == F.shiftright(y, 31)))
        place = lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
        rows = F.transform(some, lambda x: _let(place(x), lambda i: F.struct(*(v.alias(f"w{k}") for k, v in enumerate(window(i))), i.alias("i"))))
        equal = lambda x, y: reduce(and_, (x[f"w{k}"] == y[f"w{k}"] for k in range(WINDOW)))
        starts = _let(F.sort_array(rows), lambda s: F.sort_array(F.transform(neighbours(s, equal), lambda x: x["i"])))
        width = lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))).cast("long")), F.lit(0).cast("long"), lambda a, v: a + v)
        return _let(starts, width)

    return _let(words, lambda w: F.when(F.size(w) > WINDOW, covered(w)).otherwise(F.lit(0).cast("long")))


def _counts(text: Column) -> Column:
    """Struct of COUNTS of a text that isn't null."""
    def of(t: Column) -> Column:
        def lines(x: Column) -> list[Column]:
            return [F.size(x) - F.size(F.array_distinct(x)), F.size(x), F.size(F.filter(x, lambda v: F.regexp_like(v, F.lit(r"[.!?…。][\"')\]”»]*[\x20\x09-\x0D]*$"))))]

        def words(w: Column) -> list[Column]:
            return [F.size(w), F.length(F.array_join(w, "")), _repeated(w), F.size(F.filter(w, lambda v: (F.lower(v) != v) & (F.length(v) > 1) & (F.upper(v) == v))), F.size(F.filter(w, lambda v: F.regexp_like(v, F.lit(r"\p{L}"))))]

        struct = lambda names, values: F.struct(*(v.cast("long").alias(n) for n, v in zip(names, values, strict=True)))
        by_line = _let(F.filter(F.split(t, "\n", -1), lambda v: F.regexp_like(v, F.lit(WORD))), lambda x: struct(("n_dup_lines", "n_lines", "n_ended_lines"), lines(x)))
        by_word = _let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: struct(("n_words", "word_chars", "n_repeat_words", "n_cap_words", "n_letter_words"), words(w)))
        whole = struct(("n_symbols", "n_calls"), (F.regexp_count(t, F.lit(SYMBOLS)), F.regexp_count(t, F.lit("!"))))
        return F.struct(by_line.alias("l"), by_word.alias("w"), whole.alias("t"))

    return _let(text, of)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds COUNTS and base_failed to every row, without a shuffle; columns of these names are replaced.

    Whole texts are read, a null one as empty. All counts of an empty text are 0, and it fails the base check. A row's arrays
    grow with its own text only.
    """
    p = fresh(docs.columns)
    found = docs.withColumn(f"{p}counts", _counts(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    part = {"n_dup_lines": "l", "n_lines": "l", "n_ended_lines": "l", "n_words": "w", "n_repeat_words": "w", "n_cap_words": "w", "n_letter_words": "w", "word_chars": "w", "n_symbols": "t", "n_calls": "t"}
    out = found.withColumns({n: F.col(f"{p}counts.{part[n]}.{n}") for n in COUNTS}).drop(f"{p}counts")
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def votes(of: Callable[[str], Column] = F.col) -> list[Column]:
    """Each rule's vote on a measured row: 2 good, 0 bad, 1 none; none where its share has no denominator."""

    def vote(share: Column, good: float, bad: float) -> Column:
        beyond = (lambda x, y: x <= y) if good < bad else (lambda x, y: x >= y)
        against = (lambda x, y: x >= y) if good < bad else (lambda x, y: x < y)
        return F.when(against(share, F.lit(bad)), 0).when(beyond(share, F.lit(good)), 2).otherwise(1)

    safe = lambda c: lambda n: F.when(of("n_words") > 0, of(n)) if c != "few_words" else of(n)
    return [vote(share(safe(name)), good, bad) for name, (share, good, bad, _) in RULES.items()]


def fit(measured: DataFrame, rounds: int = ROUNDS) -> tuple[float, list[list[float]]]:
    """Log odds of good before any vote, and for each rule the log odds that its votes (bad, none, good) add.

    Vote patterns are counted in Spark; the driver iterates over these counts, at most 3 to the number of rules.
    """
    names = [f"v{i}" for i in range(len(RULES))]
    rows = measured.select(*(v.alias(n) for n, v in zip(names, votes(), strict=True))).groupBy(*names).count().collect()
    seen = sorted((tuple(r[:-1]), r[-1]) for r in rows)
    prior, odds = START, [[rule[3], 0.0, 0.0] for rule in RULES.values()]
    for _ in range(rounds):
        post = [1 / (1 + math.exp(-max(-40.0, min(40.0, prior + sum(o[x] for o, x in zip(odds, v, strict=True)))))) for v, _ in seen]
        total = [3 * BEFORE, 3 * BEFORE * math.exp(START)]
        tables = [[[BEFORE] * 3, [BEFORE] * 3] for _ in RULES]
        for (v, n), p in zip(seen, post, strict=True):
            for y, q in ((0, 1 - p), (1, p)):
                total[y] += n * q
                for i, x in enumerate(v):
                    tables[i][y][x] += n * q
        prior = math.log(total[1] / total[0])
        odds = [[max(low, min(high, math.log(t[1][x] / sum(t[1])) - math.log(t[0][x] / sum(t[0])))) for x, (low, high) in enumerate(BOUNDS)] for t in tables]
    return prior, odds


def judge(measured: DataFrame, model: tuple[float, list[list[float]]]) -> DataFrame:
    """Adds p_good, the posterior probability of a measured row, and kept: not base_failed, and p_good at least one half."""
    prior, odds = model
    total = F.lit(prior)
    for values, v in zip(odds, votes(), strict=True):
        total = total + F.element_at(F.array(*map(F.lit, values)), v + 1)
    return measured.withColumn("p_good", 1 / (1 + F.exp(-total))).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def judge_documents(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Every row of ``docs``, without its text if ``keep_text`` isn't set, with COUNTS, base_failed, p_good and kept; texts are measured once and written to the shared folder.

    Repeated rows are judged alike, each for itself; rows with a null id or text stay; an empty table gives an empty one.
    """
    slim = measure(docs, text_col)
    measured = staged(slim if keep_text else slim.drop(text_col), "measured")
    return judge(measured, fit(measured))
