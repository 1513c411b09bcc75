"""access, rank and select on whole texts, as expressions without a shuffle.

Positions count from 0, occurrences from 1.  ``rank`` of a text includes its
position; positions outside the text and occurrences that don't exist are NULL
(``rank`` of an absent symbol is 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _inside(text: Column, pos: Column) -> Column:
    return (pos >= 0) & (pos < F.char_length(text))


def access(text: Column, pos: Column) -> Column:
    """The symbol at pos."""
    return F.when(_inside(text, pos), F.substring(text, (pos + 1).cast("int"), F.lit(1)))


def rank(text: Column, symbol: Column, pos: Column) -> Column:
    """How often the symbol occurs in text[0..pos], pos included."""
    prefix = F.substring(text, F.lit(1), (pos + 1).cast("int"))
    return F.when(_inside(text, pos), (F.char_length(prefix) - F.char_length(F.replace(prefix, symbol, F.lit("")))).cast("long"))


def count(text: Column, symbol: Column) -> Column:
    return (F.char_length(text) - F.char_length(F.replace(text, symbol, F.lit("")))).cast("long")


def select(text: Column, symbol: str, j: int) -> Column:
    """The position of the j-th occurrence of a symbol."""
    if j < 1:
        return F.lit(None).cast("long")
    return F.when(count(text, F.lit(symbol)) >= j, F.char_length(F.substring_index(text, symbol, j)).cast("long"))


def answer_access(queries: DataFrame, sequences: DataFrame) -> DataFrame:
    """queries (seq_id, qid, pos) with the symbol at each position."""
    return queries.join(sequences, "seq_id", "left").select("seq_id", "qid", "pos", access(F.col("text"), F.col("pos")).alias("sym"))


def answer_rank(queries: DataFrame, sequences: DataFrame) -> DataFrame:
    """queries (seq_id, qid, sym, pos) with the rank of each."""
    return queries.join(sequences, "seq_id", "left").select("seq_id", "qid", "sym", "pos", rank(F.col("text"), F.col("sym"), F.col("pos")).alias("rank"))


def answer_select(queries: DataFrame, sequences: DataFrame) -> DataFrame:
    """queries (seq_id, qid, sym, j) with the position of each occurrence, found in the text without numbering others."""
    text, symbol, j = F.col("text"), F.col("sym"), F.col("j")
    pos = F.when((j >= 1) & (count(text, symbol) >= j), F.expr("char_length(substring_index(text, sym, cast(j as int)))").cast("long"))
    return queries.join(sequences, "seq_id", "left").select("seq_id", "qid", "sym", "j", pos.alias("pos"))


def positions(symbols: DataFrame) -> DataFrame:
    """(seq_id, sym, j, pos): all occurrences, numbered; the inverse of prefix_ranks."""
    by = Window.partitionBy("seq_id", "sym").orderBy("pos")
    return symbols.select("seq_id", "sym", F.row_number().over(by).cast("long").alias("j"), "pos")


def prefix_ranks(symbols: DataFrame) -> DataFrame:
    """(seq_id, pos, sym, rank): at each position the rank of its own symbol."""
    by = Window.partitionBy("seq_id", "sym").orderBy("pos")
    return symbols.select("seq_id", "pos", "sym", F.row_number().over(by).cast("long").alias("rank"))


# ---- bits: rank excludes its position


def bit_ranks(bits: DataFrame) -> DataFrame:
    """(seq_id, pos, bit, rank1, rank0): ones and zeros before each position."""
    by = Window.partitionBy("seq_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    ones = F.coalesce(F.sum(F.col("bit").cast("long")).over(by), F.lit(0))
    return bits.select("seq_id", "pos", "bit", ones.alias("rank1")).withColumn("rank0", F.col("pos") - F.col("rank1"))


def bit_select(bits: DataFrame, one: bool) -> DataFrame:
    """(seq_id, j, pos): the position of the j-th one (or zero)."""
    rows = bits.where(F.col("bit") if one else ~F.col("bit"))
    return rows.select("seq_id", F.row_number().over(Window.partitionBy("seq_id").orderBy("pos")).cast("long").alias("j"), "pos")


def bit_ranks_along(keyed: DataFrame, block: int = 1 << 16) -> DataFrame:
    """bit_ranks of one long sequence (key, pos, value): ones are counted by block of positions first, so no task sees all of it."""
    rows = keyed.withColumn("part", F.floor(F.col("pos") / block))
    ones = rows.groupBy("part").agg(F.sum(F.col("value").cast("long")).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum(F.col("value").cast("long")).over(Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.join(ones.select("part", before.alias("before")), "part").select("key", "pos", F.col("value").alias("bit"), (F.col("before") + inside).cast("long").alias("rank1"))
    return out.withColumn("rank0", F.col("pos") - F.col("rank1"))


def bit_select_along(keyed: DataFrame, one: bool, block: int = 1 << 16) -> DataFrame:
    """(key, pos, j) of the ones (or zeros) of one long sequence."""
    ranks = bit_ranks_along(keyed, block)
    return ranks.where(F.col("bit") if one else ~F.col("bit")).select("key", "pos", (F.col("rank1" if one else "rank0") + 1).alias("j"))
