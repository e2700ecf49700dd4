"""Mixing sources to target weights with DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixspark.llm.shared import fresh, staged
from helixspark.operators.order import running

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Of (source, source_size), each source's target.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` times all sizes; none gets more
    than ``most`` times its size, and the excess goes to the others by weight until none is above. In closed form: in the
    order of size over weight, the sources before some place are full, and the rest share what is left by weight; that
    place gives the highest level that holds. Places and sums up to a source come from ranges of sources, so that there may be as
    many as web hosts.
    """
    listed = sizes.withColumns({"_g": F.lit(0), "_null": F.col("source").isNull().cast("int"), "_one": F.lit(1).cast("long")})
    ranked = running(listed, "_g", ["_null", "source"], "_one").withColumnRenamed("total", "n")
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.col("n") - 1) % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(most))
    up = running(ranked.select("_g", "source", "source_size", "n", "weight", "cap", (F.col("cap") / F.col("weight")).alias("_full")), "_g", ["_full", "n"], ["cap", "weight"])
    all_ = up.agg(F.sum("source_size").alias("_size"), F.sum("weight").alias("_weight"))
    level = (F.col("_size") * float(share) - (F.col("total_cap") - F.col("cap"))) / (F.col("_weight") - (F.col("total_weight") - F.col("weight")))
    best = up.join(F.broadcast(all_)).withColumn("level", level).agg(F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).alias("level"))
    found = up.join(F.broadcast(best))  # one row
    return found.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, cell_rows: int = 20_000, size: Column | None = None, tie: Column | None = None) -> DataFrame:
    """Decide how many words of every document the mix takes; adds size, source_size, target and taken.

    Every row gets a hash-random key from seed, doc_id and ``tie`` (the text, if there is one). Keys are cut into equal
    ranges (cells) of about ``cell_rows`` rows of the table; words are summed by source and cell, and running sums over a
    source's cells tell in which cell its budget ends. A source's budget is its target: all its documents are taken whole as
    often as they fit, then those of the cells before the cut once more, and in the cell at the cut those whose words lie
    before the exact cut, the document there in part. Only rows of such cells, one a source, are shuffled and sorted by
    key; all others are decided where they are read. Weights must be positive.

    Null texts have size 0, null sources are one source, null ids and ties hash as the rest of the key; repeated rows count
    each, and rows with equal keys are equal in doc_id and tie, so that only such rows can change places; an empty table
    gives an empty one. Existing columns named like the new ones are replaced; others stay; helper columns have names that
    the table doesn't.
    """
    p = fresh(docs.columns)
    key, cell, start, before, end, s, c = (f"{p}{x}" for x in ("key", "cell", "start", "before", "end", "source", "cut"))
    own = word_count(F.col("text")) if size is None else size
    tie = (F.col("text").cast("string") if "text" in docs.columns else F.lit("")) if tie is None else tie
    name = F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), tie.cast("string"))
    base = docs.withColumn("size", own).drop("source_size", "target", "taken")
    base = base.withColumn(key, F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long"))
    cells = max(1, -(-docs.count() // cell_rows))
    base = base.withColumn(cell, F.floor(F.col(key) / F.lit(2.0**60) * cells).cast("long"))
    sums = staged(base.groupBy("source", cell).agg(F.sum("size").alias(end)), "mix")
    goal = targets(sums.groupBy("source").agg(F.sum(end).alias("source_size")), weights, share, most)
    up = W.partitionBy("source").orderBy(cell)
    ends = sums.withColumn(start, F.sum(end).over(up) - F.col(end)).withColumn(end, F.col(start) + F.col(end))
    whole = F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = (F.round("target").cast("long") - whole * F.col("source_size")).alias(f"{p}left")
    goal = goal.select(F.col("source").alias(s), "source_size", "target", whole.alias(f"{p}whole"), left)
    cuts = ends.join(goal, F.col("source").eqNullSafe(F.col(s))).where((F.col(start) <= F.col(f"{p}left")) & (F.col(f"{p}left") < F.col(end)))
    plan = goal.alias("g").join(cuts.select(F.col(s).alias(f"{p}s2"), F.col(cell).alias(c), start), F.col(s).eqNullSafe(F.col(f"{p}s2")), "left").drop(f"{p}s2")
    plan = staged(plan, "plan")
    rows = base.join(plan, F.col("source").eqNullSafe(F.col(s)))
    here = F.coalesce(F.col(cell) == F.col(c), F.lit(False))
    free = F.when(F.col(c).isNull() | (F.col(cell) < F.col(c)), F.when(F.col(f"{p}left") > 0, F.col("size")).otherwise(F.lit(0))).otherwise(F.lit(0)).cast("long")
    inside = W.partitionBy("source").orderBy(key, "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    at_cut = rows.where(here).withColumn(before, F.coalesce(F.sum("size").over(inside), F.lit(0)))
    part = F.least(F.greatest(F.col(f"{p}left") - F.col(start) - F.col(before), F.lit(0)), F.col("size"))
    both = rows.where(~here).withColumn("taken", free).unionByName(at_cut.withColumn("taken", part).drop(before))
    return both.withColumn("taken", F.col(f"{p}whole") * F.col("size") + F.col("taken")).drop(key, cell, start, s, c, f"{p}whole", f"{p}left")


def repeat_taken(mixed: DataFrame) -> DataFrame:
    """Rows as often as the mix takes them: taken over size to the nearest whole, halves up; rows of no words go once."""
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(1)).cast("int")
    again = f"{fresh(mixed.columns)}again"
    return mixed.where(times > 0).withColumn(again, F.explode(F.sequence(F.lit(1), times))).drop(again, "size", "source_size", "target", "taken")
