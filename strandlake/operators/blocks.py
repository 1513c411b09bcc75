"""One level of a block structure over texts: grid, marks, sources and in-degrees.

A pair is two neighbouring blocks; it is marked if its content also starts earlier in
the text.  An inner block of a level of at least four is a back block if both of its
pairs are marked and an earlier copy of the block doesn't overlap it; its source is
the leftmost copy.  The first block never is, and the last whole block needs only its
one pair.  A block that the text's end cuts off stays internal.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import code_points, nullable, per_sequence
from .fingerprint import leftmost

SMALL_LEVEL = 4


def level_geometry(n: Column, arity: int, roots: int, max_leaf: int) -> Column:
    """Struct (height, block_size, padding, levels) for a sequence of n symbols: the least height with roots * arity**height >= n."""
    steps = F.sequence(F.lit(0), F.lit(62))
    # Powers beyond the text don't matter; they stop growing there, so nothing overflows.
    size = F.aggregate(steps, F.struct(F.lit(1).cast("long").alias("b"), F.lit(0).cast("long").alias("h")), lambda s, _: F.when(s["b"] * roots >= n, s).otherwise(F.struct((s["b"] * arity).alias("b"), (s["h"] + 1).alias("h"))))
    levels = F.aggregate(steps, F.struct(size["b"].alias("b"), F.lit(1).cast("long").alias("k")), lambda s, _: F.when(s["b"] <= max_leaf, s).otherwise(F.struct(F.floor(s["b"] / arity).cast("long").alias("b"), (s["k"] + 1).alias("k"))))
    return F.struct(size["h"].alias("height"), size["b"].alias("block_size"), (size["b"] * roots - n).alias("padding"), levels["k"].alias("levels"))


def block_grid(sequences: DataFrame, block: int) -> DataFrame:
    """(seq_id, blk, start, len) of all blocks of a regular grid, with the text."""
    n = F.char_length("text")
    rows = sequences.where("text != ''").select("seq_id", "text", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / block))).alias("blk"))
    start = F.col("blk") * block
    return rows.select("seq_id", F.col("blk").cast("long").alias("blk"), start.cast("long").alias("start"), F.least(F.lit(block), n - start).cast("long").alias("len"), "text")


def _part(start: Column, length: int) -> Column:
    return F.substring("text", (start + 1).cast("int"), F.lit(length))


def marked_blocks(text: str, block: int) -> pd.DataFrame | None:
    """start, len, pair_marked and source of a text's blocks; in time that grows as its length, by one sort of its windows' keys."""
    if not text:
        return None
    points = code_points(text)
    n = len(points)
    start = np.arange(0, n, block)
    pairs, whole = start[start + 2 * block <= n], start[start + block <= n]
    marked, source = np.full(len(start), -1, np.int8), np.full(len(start), -1, np.int64)
    marked[: len(pairs)] = leftmost(text, points, 2 * block, pairs) < pairs
    found = leftmost(text, points, block, whole)
    source[: len(whole)] = np.where(found + block <= whole, found, -1)
    return pd.DataFrame({"blk": np.arange(len(start)), "start": start, "len": np.minimum(block, n - start), "pair_marked": pd.array(marked == 1, "boolean"), "source": nullable(source)}).assign(pair_marked=lambda d: d["pair_marked"].mask(marked < 0))


def pair_marks(sequences: DataFrame, block: int) -> DataFrame:
    """(seq_id, blk, start, len, pair_marked, source): whether the pair of a block and the next also starts earlier (NULL without a whole pair), and where the leftmost copy of a whole block is, if it ends before the block starts."""

    def make(seq_id: int, text: str) -> pd.DataFrame | None:
        found = marked_blocks(text, block)
        return None if found is None else found.assign(seq_id=seq_id)

    schema = "seq_id long, blk long, start long, len long, pair_marked boolean, source long"
    return per_sequence(sequences, schema, lambda k, t: None if (d := make(k, t)) is None else d[[c.split()[0] for c in schema.split(", ")]])


def level_blocks(sequences: DataFrame, block: int) -> DataFrame:
    """(seq_id, blk, start, is_internal, ptr_blk, ptr_off) of one level on a regular grid."""
    by = Window.partitionBy("seq_id").orderBy("blk")
    whole = F.sum((F.col("len") == block).cast("long")).over(Window.partitionBy("seq_id"))
    rows = pair_marks(sequences, block).withColumn("whole", whole).withColumn("left", F.lag("pair_marked").over(by))
    right = F.col("pair_marked") | (F.col("blk") == F.col("whole") - 1)
    back = (F.col("whole") >= SMALL_LEVEL) & (F.col("len") == block) & (F.col("blk") > 0) & F.col("left") & right & F.col("source").isNotNull()
    back = F.coalesce(back, F.lit(False))
    return rows.select(
        "seq_id", "blk", "start", (~back).alias("is_internal"),
        F.when(back, F.floor(F.col("source") / block)).cast("long").alias("ptr_blk"), F.when(back, F.col("source") % block).cast("long").alias("ptr_off"),
    )


def in_degree(blocks: DataFrame) -> DataFrame:
    """(seq_id, blk, in_degree): how many back blocks take content from each block."""
    back = blocks.where("not is_internal")
    touched = back.select("seq_id", F.col("ptr_blk").alias("blk")).unionByName(back.where("ptr_off > 0").select("seq_id", (F.col("ptr_blk") + 1).alias("blk")))
    return touched.groupBy("seq_id", "blk").agg(F.count("*").alias("in_degree"))


def checked_pointers(blocks: DataFrame, sequences: DataFrame, block: int) -> DataFrame:
    """(seq_id, checked, invalid): of each sequence's back blocks how many there are, and of how many the source overlaps the block or differs in content."""
    back = ~F.col("is_internal")
    source = F.col("ptr_blk") * block + F.col("ptr_off")
    bad = F.coalesce((source + block > F.col("start")) | (_part(source, block) != _part(F.col("start"), block)), F.lit(True))
    rows = blocks.join(sequences, "seq_id").select("seq_id", back.alias("back"), (back & bad).alias("bad"))
    return rows.groupBy("seq_id").agg(F.count_if("back").alias("checked"), F.count_if("bad").alias("invalid"))


def nearest_start(points: DataFrame, starts: DataFrame) -> DataFrame:
    """points (seq_id, pos) with the last start at or before each: one sort of both, no range join."""
    both = points.select("seq_id", "pos", F.lit(None).cast("long").alias("start"), F.lit(1).alias("kind")).unionByName(starts.select("seq_id", F.col("start").alias("pos"), F.col("start"), F.lit(0).alias("kind")))
    by = Window.partitionBy("seq_id").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("start", F.last("start", ignorenulls=True).over(by)).where("kind = 1").select("seq_id", "pos", "start")
