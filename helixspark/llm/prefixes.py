"""The trie of conversations' prefixes, keyed by digests, with sums over subtrees by pointer jumping.

A node is a distinct sequence of first turns; its key is a digest of that sequence, so equal prefixes meet by an equal join however
many conversations share them. Sums over subtrees take as many rounds as the logarithm of the greatest depth: in each, every node
adds its sum so far to the node that its pointer names, and then takes over that node's pointer.

Nothing is gathered by conversation or by node: turns are ranked by range and counts before each range, a conversation's turns are
digested in pieces of at most ``PIECE``, and pieces are joined by doubling.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixspark.llm.shared import Stage, meet, staged

#: Conversations of one block begin alike: with the first turns of the conversation that the block is named by.
BLOCK, HEADS = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
#: Turns of a conversation that are digested together.
PIECE = 64
#: A node that more than one in so many point to is broadcast to them.
SHARE = 1000


def _root() -> Column:
    """The key of the root; digests are longer."""
    return F.lit("").cast("binary")


def _sha(value: Column) -> Column:
    return F.unhex(F.sha2(value.cast("binary"), 256))


def ranked(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, part, pos, key, words): every turn's place in its conversation, from 1, by turn (null first), role and digest.

    Turns are dealt by range, counted by (range, conversation), and numbered inside these; a conversation can span many ranges.
    A null role or text becomes empty. Rows without a conv_id belong to no conversation and go. Repeated rows are turns of their own.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    key = _sha(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), key.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("key")]
    dealt = staged(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    inside = dealt.withColumn("pos", F.row_number().over(W.partitionBy("part", "conv_id").orderBy(*order)).cast("long"))
    counts = dealt.groupBy("part", "conv_id").count()
    before = counts.withColumn("before", F.coalesce(F.sum("count").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    return staged(inside.join(before, ["part", "conv_id"]).select("conv_id", "part", (F.col("pos") + F.col("before")).alias("pos"), "key", "words"), "ranked")


def rebuilt(turns: DataFrame, block: int = BLOCK, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, depth, key, words, last), and every conversation (conv_id, total), turnless ones too.

    Conversation c starts with the first h turns of conversation c - c % block, as far as there are any, and goes on after its own
    first h; h is the unsigned crc32 of c in decimal, modulo ``heads``.
    """
    counts = turns.groupBy("part", "conv_id").count()
    first = turns.where((F.col("conv_id") % block == 0) & (F.col("pos") < heads)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "key", "words"))).alias("head"))
    own = counts.groupBy("conv_id").agg(F.sum("count").alias("n")).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % block)
    known = own.join(first, "base", "left").withColumn("head", F.when(F.col("head").isNull() | (F.col("h") == 0), F.slice("head", 1, 0)).otherwise(F.slice("head", 1, F.col("h"))))
    size = F.coalesce(F.size("head"), F.lit(0))
    known = known.withColumn("lent", F.when(F.col("head").isNull(), 0).otherwise(size).cast("long")).withColumn("total", F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    known = staged(known.select("conv_id", "h", "lent", "total", "head"), "heads")
    lent = known.select("conv_id", "total", F.posexplode("head").alias("i", "x")).select("conv_id", (F.col("i") + 1).cast("long").alias("depth"), "x.key", "x.words", "total")
    pieces = counts.drop("count").join(known.drop("head"), "conv_id")
    kept = turns.join(pieces, ["part", "conv_id"]).where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("depth"), "key", "words", "total")
    every = lent.unionByName(kept)
    return every.select("conv_id", "depth", "key", "words", (F.col("depth") == F.col("total")).alias("last")), known.select("conv_id", "total")


def _chain(items: Column) -> Column:
    """Running digests of a piece's keys."""
    start = F.struct(_root().alias("d"), F.array().cast("array<binary>").alias("a"))

    def step(acc: Column, x: Column) -> Column:
        return F.get(F.transform(F.array(_sha(F.concat(acc["d"], x["key"]))), lambda d: F.struct(d.alias("d"), F.concat(acc["a"], F.array(d)).alias("a"))), 0)

    return F.aggregate(items, start, step)["a"]


def members(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, words, last, node, parent) of rebuilt turns: the digest of the prefix that ends there, and of the one before it.

    A prefix's digest is that of its last piece so far and of all pieces before; the latter are found by doubling: after k rounds
    a piece knows the digest of the 2 to the k pieces that end with it. Only conversations of more than a piece take part in that.
    """
    piece = F.floor((F.col("depth") - 1) / PIECE).cast("long")
    pieces = turns.groupBy("conv_id", piece.alias("piece")).agg(F.sort_array(F.collect_list(F.struct("depth", "key", "words", "last"))).alias("items"))
    pieces = staged(pieces.withColumn("digests", _chain(F.col("items"))), "pieces")
    whole = Stage(pieces.where(F.size("items") == PIECE).select("conv_id", "piece", F.element_at("digests", PIECE).alias("state"), F.element_at("digests", PIECE).alias("end")), "states")
    most, k = whole.df.agg(F.max("piece")).first()[0] or 0, 0
    while (1 << k) <= most:
        before = whole.df.select("conv_id", (F.col("piece") + (1 << k)).alias("piece"), F.col("state").alias("earlier"))
        new = Stage(whole.df.join(before, ["conv_id", "piece"], "left").select("conv_id", "piece", F.when(F.col("earlier").isNull(), F.col("state")).otherwise(_sha(F.concat("earlier", "state"))).alias("state"), "end"), "states")
        whole.drop()
        whole, k = new, k + 1
    after = lambda t, name: t.select("conv_id", (F.col("piece") + 1).alias("piece"), *name)
    # the digest of the prefix that ends with a piece, as its turns have it
    ends = whole.df.join(after(whole.df, [F.col("state").alias("earlier")]), ["conv_id", "piece"], "left").select("conv_id", "piece", "state", F.when(F.col("earlier").isNull(), F.col("end")).otherwise(_sha(F.concat("earlier", "end"))).alias("end"))
    joined = pieces.join(after(ends, ["state", F.col("end").alias("above")]), ["conv_id", "piece"], "left")
    node = F.when(F.col("state").isNull(), F.col("digests")).otherwise(F.transform("digests", lambda d: _sha(F.concat(F.col("state"), d))))
    row = F.transform("items", lambda x, i: F.struct(x["depth"].alias("depth"), x["words"].alias("words"), x["last"].alias("last"), F.get("nodes", i).alias("node"), F.when(i > 0, F.get("nodes", i - 1)).otherwise(F.coalesce(F.col("above"), _root())).alias("parent")))
    return joined.withColumn("nodes", node).select("conv_id", F.explode(row).alias("x")).select("conv_id", "x.*")


def rollup(nodes: DataFrame, depth: int) -> DataFrame:
    """(node, leaves, saved) summed over subtrees of nodes (node, ptr, leaves, saved); ``ptr`` is the parent, null at the top.

    One round for each doubling of the distance, up to ``depth``. A round sums what points to a node before it is shuffled, and
    broadcasts the pointers of nodes that more than one in ``SHARE`` nodes point to. Each round is written to the shared folder.
    """
    state = Stage(nodes, "rollup")
    many = state.df.count()
    for _ in range(max(0, depth - 1).bit_length()):
        up = state.df.where("ptr is not null")
        sums = up.groupBy(F.col("ptr").alias("node")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"), F.count("*").alias("_n"))
        often = sums.where(f"_n * {SHARE} > {many}").select(F.col("node").alias("ptr"))
        on = meet(up, state.df.where("ptr is not null").select(F.col("node").alias("ptr"), F.col("ptr").alias("next")), "ptr", often)
        moved = on.select("node", F.col("next").alias("ptr"), "leaves", "saved").unionByName(state.df.where("ptr is null"))
        new = Stage(moved.join(sums.drop("_n"), "node", "left").select("node", "ptr", *((F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in ("leaves", "saved"))), "rollup")
        state.drop()
        state = new
    return state.df.drop("ptr")


@dataclass
class Trie:
    """nodes: (node, conv_id, depth, parent, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens); ends: (node, conv_id) of each conversation's last turn, or of the root."""

    nodes: DataFrame
    ends: DataFrame


def trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK, heads: int = HEADS) -> Trie:
    """The trie of the rebuilt conversations; its root, of depth 0, has all of them as members. An empty table gives no nodes."""
    turns, convs = rebuilt(ranked(conversations, conv_col, turn_col, role_col, text_col), block, heads)
    every = staged(members(turns), "members")
    nodes = every.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("words").alias("words"), F.count("*").alias("n_convs"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(_root().alias("node"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("words"), "n_convs")
    nodes = staged(nodes.unionByName(root), "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = staged(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    depth, n = nodes.agg(F.max("depth"), F.count("*")).first()
    own = nodes.select("node", F.when(F.col("depth") > 1, F.col("parent")).alias("ptr"), "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    sums = rollup(own.where("depth > 0").drop("depth"), depth or 0)
    top = own.agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).where("leaves is not null").select(_root().alias("node"), "leaves", "saved")
    joined = nodes.join(sums.unionByName(top), "node")
    often = nodes.where(f"n_children * {SHARE} > {n}").select(F.col("node").alias("parent"))
    inner = meet(joined.where("depth > 0"), nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent", often)
    whole = inner.unionByName(joined.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    ends = every.where("last").select("node", "conv_id").unionByName(convs.where("total = 0").select(_root().alias("node"), "conv_id"))
    return Trie(whole.select("node", "conv_id", "depth", "parent", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")), ends)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each node of a task, whose rows stand together and in order: the digest is fed batch by batch, so only a batch is held."""
    schema = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
    node, digest = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = pc.run_end_encode(batch.column("node"))
        ids = batch.column("conv_id").cast(pa.string())
        done: list[tuple[bytes, str]] = []
        at = 0
        for key, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
            text = ",".join(ids[at:end].to_pylist())
            if key != node:
                if digest is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = key, hashlib.sha256()
            else:
                text = "," + text
            digest.update(text.encode())
            at = end
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], schema=schema)


def with_digests(t: Trie) -> DataFrame:
    """Nodes with ends_sha256, the digest of the conversations that end there, by id. Such a digest can only be made in order, so one task reads a node's ids, sorted on disk, and holds one batch of them."""
    found = t.ends.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(_digests, "node binary, ends_sha256 string")
    return t.nodes.join(found, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(_root(), 256))).drop("node", "parent")
