"""Alphabets, codes and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def alphabet(symbols: DataFrame) -> DataFrame:
    """(seq_id, sym, id, first_pos, cnt): ids in the order of first occurrence."""
    found = symbols.groupBy("seq_id", "sym").agg(F.min("pos").alias("first_pos"), F.count("*").alias("cnt"))
    return found.withColumn("id", (F.row_number().over(Window.partitionBy("seq_id").orderBy("first_pos")) - 1).cast("long"))


def leaf_codes(symbols: DataFrame) -> DataFrame:
    """(seq_id, sym, code, width): dense codes in the order of the symbols, and the bits that a code takes."""
    found = symbols.select("seq_id", "sym").distinct()
    by = Window.partitionBy("seq_id")
    code = (F.row_number().over(by.orderBy("sym")) - 1).cast("long")
    return found.select("seq_id", "sym", code.alias("code"), bit_width(F.count("*").over(by) - 1).alias("width"))


def histogram(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("seq_id", "sym").agg(F.count("*").alias("cnt"))


def bit_width(value: Column) -> Column:
    """Bits that a whole number from 0 takes; 1 for 0."""
    return F.length(F.bin(value.cast("long"))).cast("long")


def keep(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Upsert in which the first value of a key wins."""
    return df.groupBy(key).agg(F.min_by(value, order).alias(value))


def overwrite(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Upsert in which the last value of a key wins."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def upsert(df: DataFrame, key: str, **updates: Column) -> DataFrame:
    """Upsert with updates of the caller's own: any aggregate, built in or a Pandas one, by the name of its column."""
    return df.groupBy(key).agg(*[update.alias(name) for name, update in updates.items()])


def read_number(content: Column, at: int, width: int, little: bool) -> Column:
    """width bytes (7 at most) of a binary column from byte ``at`` on as a whole number, lowest byte first or last; NULL beyond the end."""
    if not 0 < width < 8:
        raise ValueError("a number has 1 to 7 bytes")
    digits = F.hex(F.substring(content, at + 1, width))
    if little:
        digits = F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(width))])
    return F.when(F.octet_length(content) >= at + width, F.conv(digits, 16, 10).cast("long"))


def loads(df: DataFrame, key: str, shards: int) -> DataFrame:
    """(shard, n_keys, n_rows) of a hash partitioning."""
    return df.groupBy(F.pmod(F.xxhash64(key), F.lit(shards)).alias("shard")).agg(F.countDistinct(key).alias("n_keys"), F.count("*").alias("n_rows"))
