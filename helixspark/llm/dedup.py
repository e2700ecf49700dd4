"""Near-duplicate documents by HyperMinHash registers, banding, and verification on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixspark.llm import textkit
from helixspark.llm.components import components
from helixspark.llm.shared import Stage, likely, release, staged
from helixspark.llm.textkit import mix64, shingle_hashes

#: Registers of 16 bits: six of the count of leading zeros, ten of the mantissa after the leading one. The highest value marks an empty one.
BANDS, WIDTH, MANTISSA = 44, 6, 10
REGISTERS = BANDS * WIDTH
EMPTY = 0xFFFF
#: Bits of a band's key that hold its number.
BAND_MASK = 63
#: Two different minima agree in zeros (one in three) and mantissa.
COLLISION = 1 / 3 / 2**MANTISSA
#: Classes, and shingles of all of them, that one side of a block of a bucket holds.
BLOCK, BLOCK_SHINGLES = 1000, 1 << 21
#: Rows of blocks that a worker is handed at once, on average.
CELL = 4096
#: Registers that an empty one looks to, in turn, for a value to borrow in its band.
_LENDERS = (mix64(np.arange(64 * REGISTERS).astype(np.uint64) + np.uint64(0x1F83D9AB)) % np.uint64(REGISTERS)).astype(np.int64).reshape(64, REGISTERS)


def registers(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of each set: (sets, REGISTERS) uint16."""
    n = len(offsets) - 1
    low = np.full(n * REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    bucket = (hashes % np.uint64(REGISTERS)).astype(np.int64) + np.repeat(np.arange(n) * REGISTERS, np.diff(offsets))
    value = mix64(hashes ^ np.uint64(0xA0761D6478BD642F))
    np.minimum.at(low, bucket, value)
    full = np.zeros(n * REGISTERS, bool)
    full[bucket] = True
    _, exponent = np.frexp((low >> np.uint64(11)).astype(np.float64))
    zeros = np.minimum(53 - exponent, 52).astype(np.uint64)
    mantissa = (low << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    packed = ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    return np.where(full, packed, np.uint16(EMPTY)).reshape(n, REGISTERS)


def filled(r: np.ndarray) -> np.ndarray:
    """Registers for banding: an empty one borrows from the first full one among its lenders, the same for every set.

    So a band of a set with few shingles agrees no more often than one of a large set; without this, sets that share one
    common shingle would share all bands in which it stands alone.
    """
    out, full = r.copy(), r != EMPTY
    row, col = np.nonzero(~full)
    for lenders in [*_LENDERS, *((np.arange(REGISTERS) + s) % REGISTERS for s in range(1, REGISTERS))]:
        if not len(row):
            break
        at = lenders[col]
        ok = full[row, at]
        out[row[ok], col[ok]] = r[row[ok], at[ok]]
        row, col = row[~ok], col[~ok]
    return out


def band_keys(r: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each set: (sets, BANDS). The low bits are the number of the band."""
    parts = filled(r).reshape(len(r), BANDS, WIDTH).astype(np.uint64)
    band = np.arange(BANDS, dtype=np.uint64)
    key = mix64(parts[:, :, 0] | parts[:, :, 1] << np.uint64(16) | parts[:, :, 2] << np.uint64(32) | parts[:, :, 3] << np.uint64(48))
    key = mix64(key ^ (parts[:, :, 4] | parts[:, :, 5] << np.uint64(16) | (band + np.uint64(1)) << np.uint64(32)))
    return (key & np.uint64(~BAND_MASK & (1 << 64) - 1) | band).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers, row by row, corrected for accidental agreement."""
    neither = ((a == EMPTY) & (b == EMPTY)).sum(axis=-1)
    return (((a == b).sum(axis=-1) - neither) / np.maximum(REGISTERS - neither, 1) - COLLISION) / (1 - COLLISION)


def floor_of(similarity: float) -> float:
    """Estimates below this are 6 standard deviations under the similarity."""
    return similarity - 6 * (similarity * (1 - similarity) / REGISTERS) ** 0.5


def _prints(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 128-bit fingerprint of each set, as two rows of signed words."""
    sums = np.zeros((2, len(h) + 1), np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mix64(h + np.uint64(1)), out=sums[0, 1:])
        np.cumsum(mix64(h ^ np.uint64(0xE7037ED1A0B428DB)), out=sums[1, 1:])
        return (sums[:, offsets[1:]] - sums[:, offsets[:-1]]).view(np.int64)


def _hashed(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Shingle sets of texts in parts of bounded size: the first text's place, hashes, offsets."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for a, z in textkit.chunks(sizes, 4 * textkit.CHUNK):
        yield a, *shingle_hashes(texts.slice(a, z - a), k)


def _sketch(k: int):
    """Rows (text, row, id, text_key): sizes, fingerprints and registers in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, h, offsets in _hashed(b.column(0), k):
                prints, n = _prints(h, offsets), np.diff(offsets)
                sketch = pa.array([x.tobytes() for x in registers(h, offsets)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(a, len(n)) for c in b.columns[1:]), pa.array(n, pa.int64()), pa.array(prints[0]), pa.array(prints[1]), sketch], ["row", "id", "text_key", "n", "p1", "p2", "sketch"])

    return run


def _sets(k: int):
    """Fingerprints and sorted shingle hashes of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, h, offsets in _hashed(b.column(0), k):
                prints = _prints(h, offsets)
                for s in range(0, len(offsets) - 1, 500):
                    part = slice(s, min(s + 500, len(offsets) - 1))
                    own = [h[x:y].tobytes() for x, y in zip(offsets[:-1][part], offsets[1:][part], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.diff(offsets)[part], pa.int64()), pa.array(prints[0][part]), pa.array(prints[1][part]), pa.array(own, pa.binary())], ["n", "p1", "p2", "hashes"])

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of all bands of each class."""
    for b in batches:
        if b.num_rows:
            keys = band_keys(_matrix(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), BANDS).cast(pa.list_(pa.int64()))], ["node", "keys"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _near(least: float):
    """Keeps rows (a, b, sketch, sketch) whose estimate reaches ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keep = pa.array(estimate(_matrix(b.column(2)), _matrix(b.column(3))) >= least)
                yield b.select([0, 1]).filter(keep)

    return run


def shared(one: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many members of the sorted set ``one`` each of the non-empty sets in ``flat`` has."""
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    return np.add.reduceat((one[at] == flat).astype(np.int64), offsets[:-1])


def _linked(percent: int):
    """Keeps rows (a, b, hashes, hashes) with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = int(shared(x, y, np.array([0, len(y)]))[0])
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _each_block(run):
    """A function of cells, that are several blocks' rows, from one of blocks (key, i, j); only blocks with rows of both kinds matter."""

    def whole(few: pa.Table, many: pa.Table) -> pa.Table:
        names = [[few[c + "1"].to_numpy() for c in ("key", "i", "j")], [many[c].to_numpy() for c in ("key", "i", "j")]]
        order = np.lexsort([np.concatenate(pair) for pair in zip(*names, strict=True)][::-1])
        sorted_ = [np.concatenate(pair)[order] for pair in zip(*names, strict=True)]
        new = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in sorted_], axis=0)))[: len(order)]
        code = np.empty(len(order), np.int64)
        code[order] = np.cumsum(new) - 1
        parts = []
        for table, own in ((few, code[: few.num_rows]), (many, code[few.num_rows :])):
            rank = np.argsort(own, kind="stable")
            parts.append((table.combine_chunks().take(pa.array(rank)), np.searchsorted(own[rank], np.arange(new.sum() + 1))))
        (f, at), (m, to) = parts
        return pa.concat_tables([run(f.slice(0, 0), m.slice(0, 0)), *(run(f.slice(at[b], at[b + 1] - at[b]), m.slice(to[b], to[b + 1] - to[b])) for b in np.flatnonzero((np.diff(at) > 0) & (np.diff(to) > 0)).tolist())])

    return whole


_PLACE = pa.schema([("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("node", pa.int64()), ("component", pa.int64()), ("near", pa.list_(pa.int64()))])


def _candidates(least: float, percent: int):
    """For one block of a bucket, by registers: what has to be verified there.

    Gives a row for each class outside the bucket's main component with its near classes of other components, and a row
    without such a list for each class that stands in one; so rows grow with classes, not with pairs. A pair counts only
    in the first band that its two share, and only where the sizes of its sets allow the similarity.
    """

    def run(few: pa.Table, many: pa.Table) -> pa.Table:
        if not few.num_rows or not many.num_rows:
            return _PLACE.empty_table()
        ids, group, n, main = (many[c].to_numpy() for c in ("node", "component", "n", "main"))
        x, c, m = (few[f + "1"].to_numpy()[:, None] for f in ("node", "component", "n"))
        regs, own = _matrix(many["sketch"].combine_chunks()), _matrix(few["sketch1"].combine_chunks())
        found = []
        for at in range(0, len(x), step := max(1, (1 << 14) // len(ids))):
            part = slice(at, at + step)
            row, other = np.nonzero((group != c[part]) & (main | (ids > x[part])) & (100 * np.minimum(n, m[part]) >= percent * np.maximum(n, m[part])))
            ok = estimate(own[row + at], regs[other]) >= least if len(row) else np.zeros(0, bool)
            found.append(np.stack((row[ok] + at, other[ok])))
        row, other = np.concatenate(found, axis=1)
        keys, mine = np.zeros((len(ids), BANDS), np.int64), np.zeros((len(x), BANDS), np.int64)
        for to, r, used in ((keys, regs, np.unique(other)), (mine, own, np.unique(row))):
            to[used] = band_keys(r[used])
        band = few["key1"][0].as_py() & BAND_MASK
        ok = ~(keys[other, :band] == mine[row, :band]).any(axis=1)
        row, other = row[ok], other[ok]
        some, first = np.unique(row, return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(ids[other]))
        met = np.unique(other)
        left = few.select(["node1", "component1"]).take(pa.array(some)).rename_columns(["node", "component"]).append_column("near", lists)
        right = many.select(["node", "component"]).take(pa.array(met)).append_column("near", pa.nulls(len(met), pa.list_(pa.int64())))
        both = pa.concat_tables([left, right])
        for at, f in enumerate(("key", "i", "j")):
            both = both.add_column(at, f, pa.array(np.full(both.num_rows, few[f + "1"][0].as_py()), _PLACE.field(f).type))
        return both.cast(_PLACE)

    return _each_block(run)


def _forest(percent: int):
    """For one block: links between components on full sets, as many as join them and no more."""

    def run(few: pa.Table, many: pa.Table) -> pa.Table:
        a, b = [], []  # components
        if few.num_rows and many.num_rows:
            sets = {x: np.frombuffer(h, np.uint64) for x, h in zip(many["node"].to_pylist(), many["hashes"].to_pylist(), strict=True)}
            label = dict(zip(many["node"].to_pylist(), many["component"].to_pylist(), strict=True))
            root: dict[int, int] = {}

            def find(c: int) -> int:
                while (up := root.get(c, c)) != c:
                    root[c] = c = root.get(up, up)
                return c

            for x, c, near, h in zip(*(few[f + "1"].to_pylist() for f in ("node", "component", "near", "hashes")), strict=True):
                one, left = np.frombuffer(h, np.uint64), near
                while left := [y for y in left if y in sets and find(label[y]) != find(c)]:
                    step, size = [], 0
                    while left and (not step or size + len(sets[left[-1]]) <= 1 << 18):
                        step.append(left.pop())
                        size += len(sets[step[-1]])
                    ns = np.array([len(sets[y]) for y in step])
                    both = shared(one, np.concatenate([sets[y] for y in step]), np.concatenate(([0], np.cumsum(ns))))
                    for y in np.array(step)[100 * both >= percent * (ns + len(one) - both)].tolist():
                        if find(label[y]) != find(c):
                            root[find(label[y])] = find(c)
                            a.append(label[y])
                            b.append(c)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return _each_block(run)


def _mixed(placed: DataFrame) -> DataFrame:
    """The buckets that hold several components."""
    return placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")


def _merged(rows: DataFrame, wholes: DataFrame) -> DataFrame:
    """Rows with each component replaced by the whole (id, component) that it is part of."""
    last = wholes.select(F.col("id").alias("component"), F.col("component").alias("whole"))
    return rows.join(last, "component", "left").withColumn("component", F.coalesce("whole", "component")).select(rows.columns)


def _met(opened: DataFrame, sets: DataFrame, least: float, percent: int, grid: bool) -> tuple[DataFrame, int]:
    """(id, component) of components that links within buckets join, and how many blocks the largest bucket has.

    Rows (key, node, component, n, sketch) are dealt to blocks. Without ``grid`` a class meets those of its own block alone:
    all, in buckets of one block; in larger ones as many as join most of a group of near copies, for one row each. With it,
    buckets of several blocks are met whole: each class outside the main component meets every block of the others.
    """
    told = ["key", "node", "component", "n", "sketch"]
    sizes = opened.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("n").alias("s")).groupBy("key").agg(F.max(F.struct("c", "component", "s")).alias("top"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    parts = lambda c, s: F.ceil(F.greatest(c / BLOCK, s / BLOCK_SHINGLES)).cast("int")
    plan = sizes.select("key", F.col("top.component").alias("largest"), "c", "top", parts(F.col("c"), F.col("s")).alias("blocks"), parts(F.col("c") - F.col("top.c"), F.col("s") - F.col("top.s")).alias("parts"))
    plan = Stage(plan.where("blocks > 1") if grid else plan, "plan")
    ready = opened.join(plan.df.drop("c", "top"), "key").withColumn("main", F.col("component") == F.col("largest"))
    deal = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = deal(F.col("blocks"), 1).alias("i")
    many = ready.select(*told, "main", block, every("parts").alias("j") if grid else F.lit(0).alias("j"))
    few = ready.where("not main").select(*told, *((every("blocks").alias("i"), deal(F.col("parts"), 2).alias("j")) if grid else (block, F.lit(0).alias("j"))))
    times = lambda n: F.col(n) if grid else F.lit(1)
    load, blocks = plan.df.agg(F.sum(F.col("c") * times("parts") + (F.col("c") - F.col("top.c")) * times("blocks")), F.max("blocks")).first()
    cell = lambda n, to="": F.pmod(F.xxhash64("key" + to, "i" + to, "j" + to), F.lit(max(1, -(-n // CELL))))
    by_cell = lambda a, b, n: a.toDF(*(c + "1" for c in a.columns)).groupBy(cell(n, "1")).cogroup(b.groupBy(cell(n)))
    places = Stage(by_cell(few, many, load or 0).applyInArrow(_candidates(least, percent), "key long, i int, j int, node long, component long, near array<long>"), "places")
    full = places.df.join(sets, "node")
    links = by_cell(full.where("near is not null"), full.where("near is null").drop("near"), places.df.count()).applyInArrow(_forest(percent), "a long, b long")
    out = staged(components(links), "components")
    for done in (plan, places):
        done.drop()
    return out, blocks or 0


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents whose word-shingle sets link at a Jaccard similarity of at least ``percent`` hundredths.

    Returns one row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id is
    component_id), text_key (a hash of the text that tells rows of one doc_id apart).

    Equal sets are one class from the start, by a 128-bit fingerprint, so copies never form pairs. Each class has 264
    HyperMinHash registers in 44 bands of 6; at a similarity of 0.8 a pair misses all bands with a chance under 2e-6, at
    0.85 under 1e-9. Empty registers borrow from full ones for banding, so that small sets don't meet by one common
    shingle. Buckets with the same members are one bucket. First each class is compared with one class alone, the
    smallest of the bucket that it shares most bands with: estimate, then full sets, then components. In buckets that
    still hold several components, classes outside the largest are compared with all of other components by registers,
    in blocks of bounded size; what is near is verified on full sets in the same blocks, which give only as many links as
    join components. Buckets of several blocks have each class meet its own block first; only what is still apart then
    meets all blocks. So no pair that shares a bucket goes untested unless its ends are linked already, and no table
    here holds pairs: all have at most a row for each class and band. Full sets are made only for classes that share a
    bucket. Counts are aggregated before shuffles, blocks are bounded by classes and by shingles, joins may be split.
    Nothing but counts and a filter of fixed size reaches the driver.

    Null and empty texts have no shingles and link with nothing (component_id is their own doc_id); rows with a null
    doc_id take part but can't name a component: it has the smallest doc_id among the others, or null if there is none,
    and then all its rows are kept; rows that repeat a doc_id are separate documents; an empty table gives an empty one;
    other columns are not read.
    """
    rows = docs.select(docs[text_col].cast("string").alias("text"), docs[id_col].cast("long").alias("id")).withColumn("text_key", F.xxhash64("text"))
    least = floor_of(percent / 100)
    numbered = rows.select("text", F.monotonically_increasing_id().alias("row"), "id", "text_key")
    marks = staged(numbered.mapInArrow(_sketch(shingle), "row long, id long, text_key long, n long, p1 long, p2 long, sketch binary"), "marks", "uncompressed")
    classes = marks.where("n > 0").groupBy("p1", "p2", "n").agg(F.min(F.struct("row", "text_key")).alias("first"), F.min("id").alias("id"), F.first("sketch").alias("sketch"))
    nodes = staged(classes.select(F.col("first.row").alias("node"), "first.text_key", "id", "n", "p1", "p2", "sketch"), "classes", "uncompressed")
    sketches = nodes.select("node", "n", "sketch")

    keys = sketches.select("node", "sketch").mapInArrow(_keyed, "node long, keys array<long>").select("node", F.explode("keys").alias("key"))
    met = keys.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("tail")).where("head <> tail")
    every = staged(keys.join(met.select("key", "head"), "key"), "buckets")
    alike = every.groupBy("key").agg(F.min("head").alias("head"), F.count("*").alias("size"), *(F.bit_xor(F.xxhash64(F.lit(s), "node")).alias(f"x{s}") for s in (0, 1)))
    number = F.col("key").bitwiseAND(F.lit(BAND_MASK).cast("long"))
    alone = alike.groupBy("size", "head", "x0", "x1").agg(F.min(F.struct(number.alias("band"), "key")).alias("first"), F.count("*").alias("bands"))
    members = staged(every.join(alone.select("first.key", "bands"), "key"), "members")
    release(docs.sparkSession)

    named = members.select("node").distinct().join(nodes.select("node", "text_key", "n", "p1", "p2"), "node")
    named = staged(named, "named")
    texts = likely(rows.select("text_key", "text"), named, "text_key").groupBy("text_key").agg(F.collect_set("text").alias("texts"))
    texts = texts.join(named.select("text_key").distinct().hint("merge"), "text_key").select(F.explode("texts").alias("text"))
    made = texts.mapInArrow(_sets(shingle), "n long, p1 long, p2 long, hashes binary")
    sets = staged(made.join(named.select("node", "n", "p1", "p2"), ["n", "p1", "p2"]).select("node", "hashes"), "sets", "uncompressed")

    best = members.where("node <> head").groupBy("node", "head").agg(F.sum("bands").alias("bands")).groupBy("node").agg(F.max(F.struct("bands", (-F.col("head")).alias("less"))).alias("best"))
    pairs = best.select((-F.col("best.less")).alias("a"), F.col("node").alias("b"))
    with_both = lambda p, t, c: p.join(t.select(F.col("node").alias("a"), F.col(c).alias("ca")), "a").join(t.select(F.col("node").alias("b"), F.col(c).alias("cb")), "b").select("a", "b", "ca", "cb")
    near = staged(with_both(pairs, sketches, "sketch").mapInArrow(_near(least), "a long, b long"), "near")
    first = staged(components(with_both(near, sets, "hashes").mapInArrow(_linked(percent), "a long, b long")), "components")

    placed = members.join(first.withColumnRenamed("id", "node"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    opened = Stage(placed.join(_mixed(placed), "key", "left_semi").join(sketches, "node"), "open", "uncompressed")
    second, blocks = _met(opened.df, sets, least, percent, grid=False)
    if blocks > 1:
        again = _merged(opened.df, second)
        again = Stage(again.join(_mixed(again), "key", "left_semi"), "open", "uncompressed")
        third = _met(again.df, sets, least, percent, grid=True)[0]
        again.drop()
        second = _merged(second, third).unionByName(third.join(second.select("id"), "id", "left_anti"))
    opened.drop()

    of_node = nodes.select("p1", "p2", "n", "id", "node").join(first.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    of_node = _merged(of_node, second)
    smallest = of_node.groupBy("component").agg(F.min("id").alias("least"))
    of_class = of_node.join(smallest, "component").select("p1", "p2", "n", F.col("least").alias("component_id"))
    out = marks.select("id", "text_key", "n", "p1", "p2").join(of_class, ["p1", "p2", "n"], "left")
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), "text_key")
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_key")
