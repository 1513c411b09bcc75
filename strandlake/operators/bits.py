"""Bit sequences on packed bits: words of 64 bits with rank support, and block trees over packed bytes.

Bits are packed lowest first.  A bit rank leaves its position out.  Answers from words
take one equi-join: rank on the word of the position, select on buckets of 64
occurrences, of which a word's own occurrences touch two at most.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tree

WORD = 64


def words(bits: DataFrame) -> DataFrame:
    """(seq_id, word, n, bits, before): 64 bits as one number, how many of them there are, and the ones before the word, of rows (seq_id, pos, bit)."""
    packed = bits.groupBy("seq_id", F.floor(F.col("pos") / WORD).cast("long").alias("word")).agg(
        F.count("*").alias("n"), F.expr(f"bit_or(shiftleft(cast(bit as bigint), cast(pos % {WORD} as int)))").alias("bits")
    )
    by = Window.partitionBy("seq_id").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    return packed.withColumn("before", F.coalesce(F.sum(F.bit_count("bits").cast("long")).over(by), F.lit(0)))


def ranks(queries: DataFrame, packed: DataFrame) -> DataFrame:
    """queries (seq_id, qid, pos) with bit, rank1 and rank0 at pos; NULL outside."""
    asked = queries.withColumn("word", F.floor(F.col("pos") / WORD).cast("long"))
    found = asked.join(packed, ["seq_id", "word"], "left").withColumn("at", (F.col("pos") % WORD).cast("int"))
    inside = F.col("at") < F.col("n")
    below = F.expr("bit_count(bits & ~shiftleft(-1L, at))")
    rank1 = F.when(inside, F.col("before") + below)
    return found.select("seq_id", "qid", "pos", F.when(inside, F.expr("(shiftright(bits, at) & 1L) = 1L")).alias("bit"), rank1.alias("rank1"), (F.col("pos") - rank1).alias("rank0"))


def select(queries: DataFrame, packed: DataFrame, one: bool) -> DataFrame:
    """queries (seq_id, qid, j) with pos of the j-th one (or zero), NULL if there is none."""
    ones = F.bit_count("bits").cast("long")
    held = packed.select("seq_id", "word", "n", (F.col("bits") if one else F.bitwise_not("bits")).alias("bits"), (F.col("before") if one else F.col("word") * WORD - F.col("before")).alias("before"), (ones if one else F.col("n") - ones).alias("held")).where("held > 0")
    bucket = lambda j: F.floor(j / WORD).cast("long")
    held = held.withColumn("bucket", F.explode(F.sequence(bucket(F.col("before")), bucket(F.col("before") + F.col("held") - 1))))
    asked = queries.withColumn("bucket", bucket(F.col("j") - 1))
    hit = asked.join(held, ["seq_id", "bucket"]).where("j > before and j <= before + held")
    at = F.expr("element_at(filter(sequence(0, 63), i -> (shiftright(bits, i) & 1L) = 1L), cast(j - before as int))")
    return queries.join(hit.select("seq_id", "qid", (F.col("word") * WORD + at).alias("pos")), ["seq_id", "qid"], "left").select("seq_id", "qid", "j", "pos")


def slices(queries: DataFrame, packed: DataFrame, width: int) -> DataFrame:
    """queries (seq_id, qid, pos) with slice: bits pos..pos+width-1 (63 at most) as a number from two neighbouring words, zeros beyond the end."""
    if not 0 < width < WORD:
        raise ValueError("a slice has 1 to 63 bits")
    by = Window.partitionBy("seq_id").orderBy("word")
    follows = F.when(F.lead("word").over(by) == F.col("word") + 1, F.lead("bits").over(by))
    pairs = packed.select("seq_id", "word", "bits", F.coalesce(follows, F.lit(0).cast("long")).alias("after"))
    found = queries.withColumn("word", F.floor(F.col("pos") / WORD).cast("long")).withColumn("at", (F.col("pos") % WORD).cast("int")).join(pairs, ["seq_id", "word"], "left")
    value = F.expr(f"(shiftrightunsigned(bits, at) | if(at = 0, 0L, shiftleft(after, {WORD} - at))) & {(1 << width) - 1}L")
    return found.select("seq_id", "qid", "pos", value.alias("slice"))


def same_bits(pairs: DataFrame, packed: DataFrame, width: int) -> DataFrame:
    """pairs (seq_id, qid, a, b) with whether width bits from a on and from b on agree; false if either leaves the sequence."""
    size = packed.groupBy("seq_id").agg(F.sum("n").alias("size"))
    left = slices(pairs.select("seq_id", "qid", F.col("a").alias("pos")), packed, width).select("seq_id", "qid", F.col("slice").alias("x"))
    right = slices(pairs.select("seq_id", "qid", F.col("b").alias("pos")), packed, width).select("seq_id", "qid", F.col("slice").alias("y"))
    found = pairs.join(left, ["seq_id", "qid"]).join(right, ["seq_id", "qid"]).join(size, "seq_id")
    same = F.col("x").eqNullSafe(F.col("y")) & (F.greatest("a", "b") + width <= F.col("size"))
    return found.select("seq_id", "qid", "a", "b", same.alias("same"))


def space(packed: DataFrame) -> DataFrame:
    """(seq_id, bits, ones, bytes): of the words and of their rank support, 8 bytes a word each."""
    return packed.groupBy("seq_id").agg(F.sum("n").alias("bits"), F.sum(F.bit_count("bits").cast("long")).alias("ones"), (2 * 8 * F.count("*")).alias("bytes"))


def byte_texts(bits: DataFrame) -> DataFrame:
    """(seq_id, n, text): the packed bytes of each sequence as characters 0 to 255, an eighth of its bits, which any tree builder takes."""
    packed = bits.groupBy("seq_id", F.floor(F.col("pos") / 8).cast("long").alias("at")).agg(F.count("*").alias("n"), F.expr("bit_or(shiftleft(cast(bit as bigint), cast(pos % 8 as int)))").alias("byte"))
    ordered = F.sort_array(F.collect_list(F.struct("at", F.chr("byte").alias("sym"))))
    return packed.groupBy("seq_id").agg(F.sum("n").alias("n"), F.array_join(F.transform(ordered, lambda x: x["sym"]), "").alias("text"))


class BitTree(tree.Tree):
    """A tree over packed bytes: prefixes are counted in bytes, occurrences in bits."""

    def occurrences(self, content: str, symbol: str) -> int:
        ones = sum(ord(c).bit_count() for c in content)
        return ones if symbol == "1" else 8 * len(content) - ones

    def bit(self, pos: int) -> bool:
        return bool(ord(self.access(pos // 8)) >> pos % 8 & 1)

    def rank1(self, pos: int) -> int:
        head = self.rank("1", pos // 8)
        return head + (ord(self.access(pos // 8)) & (1 << pos % 8) - 1).bit_count() if pos % 8 else head

    def select_bit(self, symbol: str, j: int) -> int | None:
        at = super().select(symbol, j)
        if at is None:
            return None
        left, byte = j - self.rank(symbol, at), ord(self.access(at))
        for k in range(8):
            left -= (byte >> k & 1) == (symbol == "1")
            if not left:
                return 8 * at + k
        raise AssertionError("the byte holds fewer occurrences than counted")


def tree_answers(queries: DataFrame, sequences: DataFrame, blocks: DataFrame, leaves: DataFrame, arity: int) -> DataFrame:
    """queries (seq_id, qid, op, arg) with value, from trees of byte_texts() (sequences) alone; op: access (0 or 1), rank1, rank0, select1 or select0; NULL outside."""

    def one(t: BitTree, op: str, arg: int, n: int) -> int | None:
        if op.startswith("select"):
            found = t.select_bit(op[-1], arg)
            return found if found is not None and found < n else None
        if not 0 <= arg < n:
            return None
        if op == "access":
            return int(t.bit(arg))
        ones = t.rank1(arg)
        return ones if op == "rank1" else arg - ones

    def answer(t: BitTree | None, rows: pd.DataFrame) -> pd.DataFrame:
        found = [one(t, op, int(arg), int(n)) if t else None for op, arg, n in zip(rows["op"], rows["arg"], rows["n"], strict=True)]
        return rows.assign(value=pd.array(found, "Int64"))

    asked = queries.select("seq_id", "qid", "op", "arg").join(sequences.select("seq_id", "n"), "seq_id")
    return tree.grouped(asked, blocks, leaves, arity, "seq_id long, qid long, op string, arg long, value long", answer, BitTree)
