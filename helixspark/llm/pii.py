"""Personal data in whole texts by weak supervision, with DataFrame operations only.

Base patterns always give spans. Further candidates (tokens that may be credentials) are voted on by regular-expression,
gazetteer and context labelers; expectation-maximisation over the counts of vote patterns estimates how reliable each
labeler is, and the resulting posteriors train the final classifier of spans, a naive Bayes model over span features.
The counts are of all rows and have a bounded number of groups (votes and features are small enumerations).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixspark.llm.shared import fresh, staged

#: Kinds in the order of the output. The quantifiers are possessive where what follows can't match inside, which finds
#: the same spans without deep recursion; look-behinds skip starts that only repeat a failed attempt.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
EXTRA = {"secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{8,}+"}
KINDS = [*BASE, *EXTRA]
#: Words that announce a credential.
GAZETTEER = ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "credential", "auth"]
FORMATS = r"^(?:AKIA[0-9A-Z]{16}|[0-9a-f]{12,}|gh[a-z]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{20,}|eyJ[A-Za-z0-9_-]{10,})$"
#: Characters before a candidate that labelers see.
CONTEXT = 24
#: Characters of the shortest candidate.
LEAST = 8
LABELERS = 4
FEATURES = (4, 4, 3, 3)  # sizes of the enumerations in _features
BLOCK = 256


def running(values: Column) -> Column:
    """Running sums of an array of longs, in blocks, so that long arrays don't cost their square."""
    none = F.array().cast("array<bigint>")
    add = lambda acc, v: F.struct((acc["s"] + v).alias("s"), F.concat(acc["a"], F.array(acc["s"] + v)).alias("a"))
    at = lambda s: F.struct(s.cast("long").alias("s"), none.alias("a"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))
    sums = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v))
    totals = F.aggregate(sums, at(F.lit(0)), add)["a"]
    starts = F.zip_with(totals, sums, lambda t, s: t - s)
    return F.when(F.size(values) > 0, F.flatten(F.zip_with(blocks, starts, lambda x, p: F.aggregate(x, at(p), add)["a"]))).otherwise(none)


def _found(df: DataFrame, kind: str, pattern: str, guard: Column, p: str, labelled: bool = False) -> DataFrame:
    """Adds column ``<p><kind>``: array of (s, e, v), and if ``labelled`` (l, r): start, end, match, and what stands left and right of it. Helper columns start with ``p``."""
    text = F.col(f"{p}text")
    hits, gaps, ends = (f"{p}{x}" for x in ("hits", "gaps", "ends"))
    hit = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    df = df.withColumn(hits, F.when(guard, hit).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(gaps, F.when(F.size(hits) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(ends, F.when(F.size(hits) > 0, running(F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda m, g: (F.length(m) + F.length(g)).cast("long")))).otherwise(F.array().cast("array<bigint>")))
    tail = lambda x: F.right(F.coalesce(x, F.lit("")), F.lit(CONTEXT))
    # what stands left of a match is the gap before it, the match before that, and so on, as many as have CONTEXT characters for sure
    left = lambda i: tail(F.concat(*(tail(F.get(x, i - back)) for back in range(-(-CONTEXT // LEAST), 0, -1) for x in (gaps, hits)), tail(F.get(gaps, i))))
    right = lambda i: F.left(F.concat(F.left(F.get(gaps, i + 1), F.lit(2)), F.coalesce(F.left(F.get(hits, i + 1), F.lit(2)), F.lit(""))), F.lit(2))
    both = {"l": lambda i: F.lower(left(i)), "r": right} if labelled else {}
    at = F.transform(hits, lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("s"), F.get(ends, i).alias("e"), m.alias("v"), *(f(i).alias(k) for k, f in both.items())))
    return df.withColumn(f"{p}{kind}", at).drop(hits, gaps, ends)


def _valid(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "ip":
        short = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(v, r"\."), lambda p: (F.length(short(p)) <= 3) & (F.coalesce(F.left(short(p), F.lit(3)).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _votes(c: Column) -> list[Column]:
    """Votes 1 (for), 0 (none), -1 (against) of the labelers on a candidate."""
    v, left = c["v"], c["l"]
    digits, letters = F.length(F.regexp_replace(v, "[^0-9]", "")), F.length(F.regexp_replace(v, "[^A-Za-z]", ""))
    named = F.lit(False)
    for word in GAZETTEER:
        named = named | F.contains(left, F.lit(word))
    return [
        F.when(F.regexp_like(v, F.lit(FORMATS)) & (letters > 0), 1).when(letters == 0, -1).otherwise(0),
        F.when(named, 1).otherwise(0),
        F.when(F.regexp_like(left, F.lit(r"[=:]\s*[\"']?$")), 1).when(F.regexp_like(left, F.lit(r"(?:^|[^=:\"'\s])\s+$")), -1).otherwise(0),
        F.when((letters > 0) & (digits >= 3), 1).when((letters == 0) | (digits <= 1), -1).otherwise(0),
    ]


def _features(c: Column) -> list[Column]:
    """Features of a span, each a small enumeration: length, letters, share of digits, what stands right of it."""
    v = c["v"]
    n, digits = F.length(v), F.length(F.regexp_replace(v, "[^0-9]", ""))
    return [
        F.when(n < 12, 0).when(n < 20, 1).when(n < 40, 2).otherwise(3),
        F.when(F.regexp_like(v, F.lit("^[0-9+/_-]+$")), 0).when(F.regexp_like(v, F.lit("^[0-9a-f]+$")), 1).when(F.regexp_like(v, F.lit("^[0-9A-Z]+$")), 2).otherwise(3),
        F.when(digits * 5 < n, 0).when(digits * 5 < n * 3, 1).otherwise(2),
        F.when(F.regexp_like(c["r"], F.lit("^[\"']")), 0).when(F.regexp_like(c["r"], F.lit(r"^(?:[\s,.;)]|$)")), 1).otherwise(2),
    ]


def fit(candidates: DataFrame, rounds: int = 40) -> list[list[float]]:
    """Reliabilities by expectation-maximisation over counts of vote patterns, then the classifier's log odds: a bias, and one list for each feature. ``candidates`` has one, as ``_found`` gives them, in column c of each row."""
    c = F.col("c")
    names = [f"v{i}" for i in range(LABELERS)] + [f"f{i}" for i in range(len(FEATURES))]
    rows = candidates.select(*(x.alias(n) for x, n in zip(_votes(c) + _features(c), names, strict=True))).groupBy(*names).count().collect()
    groups = sorted((tuple(r[:LABELERS]), tuple(r[LABELERS:-1]), r[-1]) for r in rows)
    votes = sorted({g[0] for g in groups})
    counts = {v: sum(g[2] for g in groups if g[0] == v) for v in votes}
    post = {v: 1 / (1 + math.exp(-2.0 * sum(v))) for v in votes}
    for _ in range(rounds):
        total = [1.0, 1.0]
        table = [[[1.0] * 3 for _ in range(LABELERS)] for _ in range(2)]
        for v in votes:
            for y, p in ((1, post[v]), (0, 1 - post[v])):
                total[y] += counts[v] * p
                for i, x in enumerate(v):
                    table[y][i][x + 1] += counts[v] * p
        for v in votes:
            odds = math.log(total[1] / total[0]) + sum(math.log(table[1][i][x + 1] / sum(table[1][i])) - math.log(table[0][i][x + 1] / sum(table[0][i])) for i, x in enumerate(v))
            post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    seen = [[[1.0] * k for k in FEATURES] for _ in range(2)]
    total = [1.0, 1.0]
    for v, f, n in groups:
        for y, p in ((1, post[v]), (0, 1 - post[v])):
            total[y] += n * p
            for i, x in enumerate(f):
                seen[y][i][x] += n * p
    bias = math.log(total[1] / total[0])
    odds = [[math.log(seen[1][i][x] / sum(seen[1][i])) - math.log(seen[0][i][x] / sum(seen[0][i])) for x in range(k)] for i, k in enumerate(FEATURES)]
    reliable = [[math.log(table[1][i][x] / sum(table[1][i])) - math.log(table[0][i][x] / sum(table[0][i])) for x in range(3)] for i in range(LABELERS)] if votes else [[0.0] * 3] * LABELERS
    return [[bias], *odds, *reliable]


def _score(c: Column, model: list[list[float]]) -> Column:
    """Log odds of a span: its features, and the labelers' votes by their reliability."""
    total = F.lit(model[0][0])
    for values, x in zip(model[1:], [*_features(c), *(v + 1 for v in _votes(c))], strict=True):
        total = total + F.element_at(F.array(*map(F.lit, values)), x.cast("int") + 1)
    return total


def find_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``pii_spans``: array of (kind int, s long, e long), sorted; kind is the place in ``KINDS``, positions are code points, end exclusive.

    Base spans are leftmost and non-overlapping for each kind; matches that fail their check are dropped without retry.
    A candidate for a credential is a token of 8 or more letters, digits and +/_- with a digit in it; labelers see it and the
    ``CONTEXT`` characters before it. Two scans of the text: the first writes all candidates to the shared folder, where
    votes and features are counted; the second finds spans. No shuffle but that of the counts; no row leaves its task.
    A null or empty text has no spans; an empty table gives an empty one; every row is kept, repeated ones too; a column
    named pii_spans is replaced; helper columns have names that the table doesn't.
    """
    p = fresh(docs.columns)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digit = F.regexp_like(f"{p}text", F.lit("[0-9]"))
    some = docs.withColumn(f"{p}text", text)
    # an inner explode would add a filter that holds the whole expression of the array, many times
    seen = _found(some.select(f"{p}text"), "secret", EXTRA["secret"], digit, p, True).select(F.explode_outer(f"{p}secret").alias("c")).where("c is not null")
    model = fit(staged(seen, "candidates"))
    for kind, pattern in (BASE | EXTRA).items():
        some = _found(some, kind, pattern, {"email": F.contains(f"{p}text", F.lit("@")), "phone": F.contains(f"{p}text", F.lit("+"))}.get(kind, digit), p, kind in EXTRA)
    span = lambda k: lambda c: F.struct(F.lit(k).alias("kind"), c["s"].alias("s"), c["e"].alias("e"))
    valid = lambda kind: lambda c: _valid(kind, c["v"])
    parts = [F.transform(F.filter(f"{p}{kind}", valid(kind)), span(k)) for k, kind in enumerate(BASE)]
    parts += [F.transform(F.filter(f"{p}{kind}", lambda c: _score(c, model) > 0), span(len(BASE))) for kind in EXTRA]
    return some.withColumn("pii_spans", F.array_sort(F.concat(*parts))).drop(f"{p}text", *(f"{p}{k}" for k in KINDS))


def span_text(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(found: DataFrame, text_col: str = "text") -> DataFrame:
    """Replaces every span by its kind in angle brackets, overlapping ones together by that of the earliest (then longest), and drops pii_spans. A null text stays null."""
    text = F.col(text_col)
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    order = F.array_sort(F.transform("pii_spans", lambda x: F.struct(x["s"], -x["e"], x["kind"], x["e"].alias("e"))))
    start = F.struct(F.lit(0).cast("long").alias("p"), F.lit("").alias("t"))
    step = lambda a, x: F.when(x["s"] < a["p"], F.struct(F.greatest(a["p"], x["e"]).alias("p"), a["t"].alias("t"))).otherwise(F.struct(x["e"].alias("p"), F.concat(a["t"], F.substr(text, (a["p"] + 1).cast("int"), (x["s"] - a["p"]).cast("int")), F.element_at(names, x["kind"] + 1)).alias("t")))
    new = F.aggregate(order, start, step, lambda a: F.concat(a["t"], F.substr(text, (a["p"] + 1).cast("int"))))
    return found.withColumn(text_col, F.when(text.isNull() | (F.size("pii_spans") == 0), text).otherwise(new)).drop("pii_spans")
