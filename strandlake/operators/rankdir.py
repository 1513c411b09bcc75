"""Rank directories: counts of each symbol by block, and before each block.

A directory answers rank and select by touching one block's text, however long the
sequence: one equi-join for rank, one for select (on the block that the running counts
single out)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import direct


def blocks(sequences: DataFrame, block: int) -> DataFrame:
    """(seq_id, blk, content): texts cut into blocks, in one pass over each text."""
    rows = sequences.where("text != ''").select("seq_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))).alias("blk", "content"))
    return rows.select("seq_id", F.col("blk").cast("long").alias("blk"), "content")


def build(sequences: DataFrame, block: int) -> DataFrame:
    """(seq_id, blk, sym, cnt, prefix_cnt) of the symbols that occur in each block."""
    chars = blocks(sequences, block).select("seq_id", "blk", F.explode(F.split("content", "")).alias("sym")).where("sym != ''")
    counts = chars.groupBy("seq_id", "blk", "sym").agg(F.count("*").alias("cnt"))
    before = F.sum("cnt").over(Window.partitionBy("seq_id", "sym").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("prefix_cnt", F.coalesce(before, F.lit(0)))


def rank(queries: DataFrame, directory: DataFrame, sequences: DataFrame, block: int) -> DataFrame:
    """queries (seq_id, qid, sym, pos) with the rank: the last count at or before the block, corrected inside it."""
    asked = queries.withColumn("blk", F.floor(F.col("pos") / block).cast("long"))
    # A symbol absent from the query's block still has a count from the last block that holds it.
    known = directory.join(asked.select("seq_id", "sym").distinct(), ["seq_id", "sym"], "left_semi")
    both = asked.select("seq_id", "sym", "blk", "qid", "pos", F.lit(None).cast("long").alias("upto"), F.lit(0).alias("kind")).unionByName(
        known.select("seq_id", "sym", "blk", F.lit(None).cast("long").alias("qid"), F.lit(None).cast("long").alias("pos"), (F.col("prefix_cnt") + F.col("cnt")).alias("upto"), F.lit(1).alias("kind"))
    )
    by = Window.partitionBy("seq_id", "sym").orderBy("blk", "kind").rowsBetween(Window.unboundedPreceding, 0)
    based = both.withColumn("base", F.coalesce(F.last("upto", ignorenulls=True).over(by), F.lit(0))).where("kind = 0")
    found = based.join(blocks(sequences, block), ["seq_id", "blk"], "left")
    inside = direct.rank(F.col("content"), F.col("sym"), F.col("pos") % block)
    return found.select("seq_id", "qid", "sym", "pos", (F.col("base") + inside).alias("rank"))


def select(queries: DataFrame, directory: DataFrame, sequences: DataFrame, block: int) -> DataFrame:
    """queries (seq_id, qid, sym, j) with pos of the j-th occurrence, NULL if there is none."""
    hit = (F.col("j") > F.col("prefix_cnt")) & (F.col("j") <= F.col("prefix_cnt") + F.col("cnt"))
    found = queries.join(directory, ["seq_id", "sym"]).where(hit).join(blocks(sequences, block), ["seq_id", "blk"])
    at = F.expr("char_length(substring_index(content, sym, cast(j - prefix_cnt as int)))")
    found = found.select("seq_id", "qid", (F.col("blk") * block + at).cast("long").alias("pos"))
    return queries.join(found, ["seq_id", "qid"], "left").select("seq_id", "qid", "sym", "j", "pos")


def update(directory: DataFrame, added: DataFrame, block: int) -> DataFrame:
    """The directory after whole blocks were appended: added (seq_id, blk, content) come after all known blocks of their sequences."""
    chars = added.select("seq_id", "blk", F.explode(F.split("content", "")).alias("sym")).where("sym != ''")
    new = chars.groupBy("seq_id", "blk", "sym").agg(F.count("*").alias("cnt"))
    last = directory.groupBy("seq_id", "sym").agg(F.max(F.col("prefix_cnt") + F.col("cnt")).alias("known"))
    before = F.coalesce(F.sum("cnt").over(Window.partitionBy("seq_id", "sym").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = new.withColumn("inner", before).join(last, ["seq_id", "sym"], "left")
    return directory.unionByName(new.select("seq_id", "blk", "sym", "cnt", (F.coalesce("known", F.lit(0)) + F.col("inner")).alias("prefix_cnt")))
