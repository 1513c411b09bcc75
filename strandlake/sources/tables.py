"""Sequences from tables and files.

A sequence is a row (seq_id, text) or, in long form, rows (seq_id, pos, sym) with
positions from 0; a bit sequence has (seq_id, pos, bit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one block when positions are counted along a dense key.
KEY_BLOCK = 1 << 16


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(df: DataFrame, seq_id: str, text: str) -> DataFrame:
    """(seq_id, text) of the rows with a text."""
    return df.select(F.col(seq_id).cast("long").alias("seq_id"), F.col(text).alias("text")).where("text is not null")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """One sequence a file: (path, text). A missing path is an error of Spark's."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """One sequence a file: (path, content), the bytes as they are."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def random_text(spark: SparkSession, n: int, alphabet: int = 16, first: int = 0, seed: int = 1, seq_id: int = 0) -> DataFrame:
    """(seq_id, pos, sym) of n uniform symbols first..first+alphabet-1."""
    return spark.range(n).select(F.lit(seq_id).cast("long").alias("seq_id"), F.col("id").alias("pos"), (F.floor(F.rand(seed) * alphabet) + first).cast("int").alias("sym"))


def symbols(sequences: DataFrame) -> DataFrame:
    """Long form of (seq_id, text): one row a character."""
    # split('') gives a trailing empty string only for empty texts.
    chars = sequences.where("text != ''").select("seq_id", F.posexplode(F.split("text", "")).alias("pos", "sym"))
    return chars.where("sym != ''").select("seq_id", F.col("pos").cast("long").alias("pos"), "sym")


def categorical(df: DataFrame, seq_id: Column, order: list[str], symbol: Column) -> DataFrame:
    """Long form of an ordered column; order must be total within a sequence."""
    rows = df.select(seq_id.cast("long").alias("seq_id"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], symbol.alias("sym"))
    by = Window.partitionBy("seq_id").orderBy(*[f"_o{k}" for k in range(len(order))])
    return rows.select("seq_id", (F.row_number().over(by) - 1).cast("long").alias("pos"), "sym")


def along_key(df: DataFrame, key: str, value: Column, block: int = KEY_BLOCK) -> DataFrame:
    """One sequence over a whole table, ordered by a unique whole-number key: (key, pos, value).

    Keys fall into blocks of ``block`` values; rows are counted by block, the (few) counts are
    summed up, and rows are numbered inside their block, so no task sees the whole sequence.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), value.alias("value")).withColumn("part", F.floor(F.col("key") / block))
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("part", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    return rows.join(counts, "part").select("key", (F.col("before") + inside).cast("long").alias("pos"), "value")


def bits_from_bytes(df: DataFrame, seq_id: str, content: str) -> DataFrame:
    """(seq_id, pos, bit): 8 bits a byte, the lowest first."""
    size = F.octet_length(content)
    at = F.explode(F.sequence(F.lit(0), size - 1)).alias("at")
    each = df.where(F.coalesce(size, F.lit(0)) > 0).select(F.col(seq_id).cast("long").alias("seq_id"), F.col(content).alias("content"), at)
    byte = F.conv(F.hex(F.expr("substring(content, at + 1, 1)")), 16, 10).cast("int")
    each = each.select("seq_id", "at", byte.alias("byte"), F.explode(F.array(*[F.lit(k) for k in range(8)])).alias("k"))
    return each.select("seq_id", (F.col("at").cast("long") * 8 + F.col("k")).alias("pos"), F.expr("(shiftright(byte, k) & 1) = 1").alias("bit"))


def bits_from_chars(sequences: DataFrame, ones: str) -> DataFrame:
    """(seq_id, pos, bit): whether each character is one of ``ones``."""
    return symbols(sequences).select("seq_id", "pos", (F.instr(F.lit(ones), F.col("sym")) > 0).alias("bit")) if ones else symbols(sequences).select("seq_id", "pos", F.lit(False).alias("bit"))
