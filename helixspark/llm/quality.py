"""Quality by an interpolated modified Kneser-Ney model of characters, trained on trusted text."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixspark.llm import textkit
from helixspark.llm.shared import Stage, likely, new_path, release, staged
from helixspark.sources.ranges import open_uri

#: Grams are 64-bit integers of so many symbols, BITS each: EDGE stands before a text's start, UNKNOWN for all characters
#: that aren't among the KNOWN most frequent ones of trusted text, the others for one character each.
ORDER, BITS, EDGE, UNKNOWN = 5, 12, 0, 1
KNOWN = (1 << BITS) - 2
#: Characters of a block, the unit in which texts meet their grams' probabilities; a longer text is a block of its own.
BLOCK = 1 << 25
#: Distinct grams that a worker counts before it hands them on.
HELD = 1 << 22


class Symbols:
    """The symbol of each code point, from the known code points in order of rank."""

    def __init__(self, known: list[int]):
        self.known = known

    @functools.cached_property
    def table(self) -> np.ndarray:
        table = np.full(0x110000, UNKNOWN, np.uint16)
        table[self.known] = np.arange(len(self.known)) + UNKNOWN + 1
        return table

    def __getstate__(self) -> dict:
        return {"known": self.known}


def windows(texts: list[str], symbols: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each character, texts end to end, and the texts' offsets."""
    cp, offsets = textkit.code_points(texts)
    own = symbols.table[cp].astype(np.int64)
    at = np.arange(len(cp)) - np.repeat(offsets[:-1], np.diff(offsets))
    grams = own.copy()
    for back in range(1, ORDER):
        grams[back:] |= np.where(at[back:] < back, EDGE, own[:-back]) << (BITS * back)
    return grams, offsets


class Grams:
    """Distinct grams of texts that are added in parts, in order, with their counts."""

    def __init__(self, symbols: Symbols) -> None:
        self.symbols, self.grams, self.n = symbols, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, texts: list[str]) -> None:
        grams, n = np.unique(windows(texts, self.symbols)[0], return_counts=True)
        every = np.concatenate((self.grams, grams))
        order = np.argsort(every, kind="stable")
        every, n = every[order], np.concatenate((self.n, n))[order]
        first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))[: len(every)])
        self.grams, self.n = every[first], np.add.reduceat(n, first) if len(first) else n


def _parts(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    for a, z in textkit.chunks(sizes):
        yield a, pc.fill_null(texts.slice(a, z - a), "").to_pylist()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows (doc_id, text, ...) of a partition as blocks."""
    held, size = [], 0
    for b in batches:
        start = 0
        for i, n in enumerate(pc.fill_null(pc.utf8_length(b["text"]), 0).to_pylist()):
            if size and size + n > BLOCK:
                if i > start:
                    held.append(b.slice(start, i - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, i
            size += n
        if start < b.num_rows:
            held.append(b.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _asked(symbols: Symbols, folder: str):
    """Writes each block's rows, compressed, to a file of its own in the shared folder; gives the file's name and the block's distinct grams. An attempt that is lost leaves files that nothing names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _cut(batches):
            seen = Grams(symbols)
            for _, texts in _parts(rows["text"].combine_chunks()):
                seen.add(texts)
            system, base = open_uri(folder)
            name = f"{uuid.uuid4().hex}.block"
            system.create_dir(base)
            with system.open_output_stream(f"{base}/{name}", compression=None) as out, pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as writer:
                writer.write_table(rows.combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.ListArray.from_arrays(pa.array([0, len(seen.grams)], pa.int32()), pa.array(seen.grams))], ["block", "grams"])

    return run


def _characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Code points of texts and their counts."""
    total = np.zeros(0x110000, np.int64)
    for b in batches:
        for _, texts in _parts(b["text"]):
            total += np.bincount(textkit.code_points(texts)[0], minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["code", "n"])


def _counted(symbols: Symbols):
    """Grams of texts and their counts; a gram may come more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Grams(symbols)
        for b in batches:
            for _, texts in _parts(b["text"]):
                seen.add(texts)
                if len(seen.grams) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(seen.grams), pa.array(seen.n)], ["gram", "n"])
                    seen = Grams(symbols)
        yield pa.RecordBatch.from_arrays([pa.array(seen.grams), pa.array(seen.n)], ["gram", "n"])

    return run


def _score(symbols: Symbols, folder: str):
    """Rows of a block with the number of characters and the perplexity in place of the text."""

    def run(block: pa.Table, known: pa.Table) -> pa.Table:
        system, base = open_uri(folder)
        with system.open_input_file(f"{base}/{block['name'][0].as_py()}") as file:
            rows = pa.ipc.open_stream(file).read_all().combine_chunks()
        order = np.argsort(known["gram"].to_numpy(), kind="stable")
        grams, log_p = known["gram"].to_numpy()[order], known["log_p"].to_numpy()[order].astype(np.float64)
        n, mean = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows)
        for a, texts in _parts(rows["text"].combine_chunks()):
            ends, offsets = windows(texts, symbols)
            part = slice(a, a + len(texts))
            n[part] = np.diff(offsets)
            if len(ends):
                at = np.minimum(np.searchsorted(grams, ends), len(grams) - 1)
                if not len(grams) or (grams[at] != ends).any():
                    raise RuntimeError(f"grams of {block['name'][0].as_py()} lack a probability")
                sums = np.concatenate(([0.0], np.cumsum(log_p[at])))
                mean[part] = (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(n[part], 1)
        out = {"doc_id": rows["doc_id"], "n_chars": pa.array(n), "perplexity": pa.array(np.exp(-mean), mask=n == 0)}
        return pa.table(out | {name: rows[name] for name in rows.column_names[2:]})

    return run


def _prefix() -> Column:
    return F.shiftright("gram", BITS)


def _suffix(order: int) -> Column:
    return F.col("gram").bitwiseAND(F.lit((1 << (BITS * (order - 1))) - 1).cast("long"))


def estimate(counts: DataFrame, made: list[Stage]) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: (gram, w) and (context, b), weights and back-offs, from (gram, n) of the highest order.

    The highest order uses counts, lower ones continuation counts (in how many ways a gram is extended to the left).
    Three discounts an order come from its counts of counts, which are all that reaches the driver. Counts are joined
    with their contexts' totals by key, in shards. Tables that are written are added to ``made``.
    """
    out = []
    level = counts
    for order in range(ORDER, 0, -1):
        made.append(Stage(level, f"order{order}"))
        level = made[-1].df
        cc = {r["n"]: r["c"] for r in level.where("n <= 4").groupBy("n").agg(F.count("*").alias("c")).collect()}
        n1, n2, n3, n4 = (cc.get(i, 0) or 1 for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [min(max(x, 0.05), i * 0.95) for i, x in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        rows = level.withColumn("context", _prefix()).withColumn("off", off)
        totals = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("off").alias("free"))
        weights = rows.join(totals.hint("merge"), "context").select("gram", ((F.col("n") - F.col("off")) / F.col("total")).alias("w"))
        out.insert(0, (weights, totals.select("context", (F.col("free") / F.col("total")).alias("b"))))
        level = level.groupBy(_suffix(order).alias("gram")).agg(F.count("*").alias("n"))
    return out


def probabilities(model: list[tuple[DataFrame, DataFrame]], grams: DataFrame, made: list[Stage]) -> DataFrame:
    """(gram, p) of distinct grams: the last character's probability after the others, interpolated from the lowest order up.

    Each order's weights, back-offs and lower probabilities meet its distinct grams in joins by key. A character that
    trusted text lacks shares one equal part of the lowest order.
    """
    asked = [grams]
    for order in range(ORDER, 1, -1):
        asked.insert(0, asked[0].select(_suffix(order).alias("gram")).distinct())
    characters, backs = model[0]
    free = backs.first()
    base = (free["b"] if free else 1.0) / (characters.count() + 1)
    p = asked[0].join(characters.hint("merge"), "gram", "left").select("gram", (F.coalesce("w", F.lit(0.0)) + base).alias("p"))
    for order in range(2, ORDER + 1):
        weights, backs = model[order - 1]
        made.append(Stage(p, f"lower{order}"))
        lower = made[-1].df.select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
        found = asked[order - 1].join(weights.hint("merge"), "gram", "left").withColumn("context", _prefix()).withColumn("suffix", _suffix(order))
        found = found.join(backs.hint("merge"), "context", "left").join(lower.hint("merge"), "suffix")
        p = found.select("gram", (F.coalesce("w", F.lit(0.0)) + F.coalesce("b", F.lit(1.0)) * F.col("lower")).alias("p"))
    return p


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of labelled rows of good quality that aren't toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def perplexities(docs: DataFrame, trusted: DataFrame, keep: tuple[str, ...] = ("lang",)) -> DataFrame:
    """(doc_id, n_chars, perplexity) and the columns of ``keep`` of every document under the model of trusted documents.

    Trusted texts alone are joined with the ids and staged; their KNOWN most frequent characters have symbols of their own.
    Documents are cut into blocks of 32 million characters;
    every distinct gram of the corpus gets its probability by joins on grams, and a block asks for each of its own once.
    The blocks' texts are written, compressed, when their grams are taken, and read from there where their answers meet, so that
    documents are read once besides the trusted ones and may come in any order. Counts, model and answers are sharded by gram and
    grow with the corpus; only a filter of fixed size is
    broadcast. Perplexity is null for a null or empty text.
    """
    kept = [docs[c].alias(c) for c in keep]
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *kept)
    good = likely(slim.select("doc_id", "text"), trusted, "doc_id").join(trusted.hint("merge"), "doc_id")
    made = [Stage(good.select("text"), "trusted")]
    good = made[0].df
    known = good.mapInArrow(_characters, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "code").limit(KNOWN).collect()
    symbols = Symbols([r["code"] for r in known])
    counts = good.mapInArrow(_counted(symbols), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    folder = new_path(docs.sparkSession, "blocks")
    blocks = staged(slim.mapInArrow(_asked(symbols, folder), "block string, grams array<long>"), "asked")
    asked = blocks.select("block", F.explode("grams").alias("gram"))
    grams = Stage(asked.select("gram").distinct(), "grams")
    made.append(grams)
    p = staged(probabilities(estimate(counts, made), grams.df, made), "probabilities")
    for table in made:
        table.drop()
    release(docs.sparkSession)
    answers = asked.join(p.hint("merge"), "gram").select("block", "gram", F.log("p").cast("float").alias("log_p"))
    extra = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return blocks.select(F.col("block").alias("name")).groupBy("name").cogroup(answers.groupBy("block")).applyInArrow(_score(symbols, folder), f"doc_id long, n_chars long, perplexity double{extra}")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, margin: float = 1.1, folds: int = 5, pull: float = 200.0) -> DataFrame:
    """Keep documents whose perplexity is at most their language's threshold; (doc_id, lang, n_chars, perplexity, threshold, kept).

    One of ``folds`` trusted ids, by hash, is held out and the model is trained on the others. A language's threshold is
    ``margin`` times the ``quantile`` of its held-out documents' perplexities. With few of them that quantile is nearly
    their maximum; so it is taken over logarithms from the language's median, and drawn to the quantile that all
    languages have from their medians, as much as ``pull`` documents weigh. A language without any (null is a language)
    takes the quantile over all of them; where none is held out at all, every document is kept. Null and empty texts have
    no perplexity and are kept. One row for each input row, repeated ones too; an empty table gives an empty one;
    columns but doc_id, text, lang are not read; label rows count by doc_id.
    """
    trusted = trusted_ids(labels)
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(folds)) == 0
    scores = staged(perplexities(docs, trusted.where(~held_out)), "scores")
    good = scores.join(trusted.where(held_out).hint("merge"), "doc_id").where("perplexity is not null").select(F.col("lang").alias("_lang"), F.log("perplexity").alias("x"))
    good = staged(good, "held-out")
    at = lambda x, q: F.percentile_approx(x, q, 10_000)
    middles = good.groupBy("_lang").agg(at("x", 0.5).alias("middle"), F.count("*").alias("n"))
    away = good.join(middles.withColumnRenamed("_lang", "_l"), F.col("_lang").eqNullSafe(F.col("_l"))).withColumn("d", F.col("x") - F.col("middle"))
    every, spread = good.agg(at("x", quantile)).first()[0], away.agg(at("d", quantile)).first()[0]
    drawn = (F.col("n") * F.col("q") + pull * F.lit(spread).cast("double")) / (F.col("n") + pull)
    by_lang = away.groupBy("_lang", "middle", "n").agg(at("d", quantile).alias("q")).select("_lang", F.exp(F.col("middle") + drawn).alias("threshold"))
    out = scores.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    out = out.withColumn("threshold", margin * F.coalesce("threshold", F.exp(F.lit(every).cast("double"))))
    return out.withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))).select("doc_id", "lang", "n_chars", "perplexity", "threshold", "kept")
