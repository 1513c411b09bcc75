"""Answers from block trees alone: access by joins, rank and select by groups.

``access`` takes one join a level: a back block's source and the numbers of its
children are in its own row.  ``rank`` and ``select`` read a tree and its rank directory
once for all queries of a sequence.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import spread


def access(queries: DataFrame, blocks: DataFrame, leaves: DataFrame, arity: int, levels: int) -> DataFrame:
    """queries (seq_id, qid, pos) with sym, the symbol at pos (NULL outside). levels: an upper bound of the trees' levels."""
    tops = blocks.groupBy("seq_id").agg(F.max("level").alias("top"))
    sizes = blocks.groupBy("seq_id", "level").agg(F.max("block_size").alias("size"))
    state = queries.join(tops, "seq_id", "left").join(sizes.withColumnRenamed("level", "top"), ["seq_id", "top"], "left")
    state = state.select("seq_id", "qid", "pos", "top", F.floor(F.col("pos") / F.col("size")).cast("long").alias("blk"), (F.col("pos") % F.col("size")).alias("off"), F.lit(None).cast("long").alias("leaf"))
    nodes = blocks.select("seq_id", "level", "blk", "block_size", "is_internal", "ptr_off", "internal_rank", "ptr_child_base", "ptr_next_child_base")
    for level in range(levels - 1, -1, -1):
        here = nodes.where(F.col("level") == level).drop("level")
        state = state.join(here, ["seq_id", "blk"], "left")
        on = F.col("top") >= level
        hop = ~F.col("is_internal")
        moved = F.when(hop, F.col("ptr_off") + F.col("off")).otherwise(F.col("off"))
        crossed = hop & (moved >= F.col("block_size"))
        inside = F.when(crossed, moved - F.col("block_size")).otherwise(moved)
        base = F.when(crossed, F.col("ptr_next_child_base")).when(hop, F.col("ptr_child_base")).otherwise(F.col("internal_rank") * arity)
        child = F.floor(F.col("block_size") / arity)
        if level:
            blk, off = base + F.floor(inside / child), inside % child
            state = state.select("seq_id", "qid", "pos", "top", F.when(on, blk).otherwise(F.col("blk")).cast("long").alias("blk"), F.when(on, off).otherwise(F.col("off")).cast("long").alias("off"), "leaf")
        else:
            leaf = (base / arity).cast("long")
            state = state.select("seq_id", "qid", "pos", inside.cast("long").alias("off"), leaf.alias("leaf_blk"))
    found = state.join(leaves, ["seq_id", "leaf_blk"], "left")
    return found.select("seq_id", "qid", "pos", F.when((F.col("pos") >= 0) & (F.col("off") < F.char_length("content")), F.substring("content", (F.col("off") + 1).cast("int"), F.lit(1))).alias("sym"))


def _lists(rows: pd.DataFrame, *names: str) -> Iterator[tuple]:
    """Rows as tuples of whole numbers and truth values; -1 for NULL."""
    columns = [rows[c].astype(bool) if c == "is_internal" else (rows[c].astype("float64").fillna(-1) if rows[c].isna().any() else rows[c]).astype("int64") for c in names]
    return zip(*(c.tolist() for c in columns), strict=True)


def _with_content(blocks: DataFrame, leaves: DataFrame) -> DataFrame:
    """Blocks with their leaf's content; as build() gives them, or joined."""
    if "content" in blocks.columns:
        return blocks
    tagged = leaves.withColumnRenamed("leaf_blk", "internal_rank").withColumn("level", F.lit(0)).withColumn("is_internal", F.lit(True))
    return blocks.join(tagged, ["seq_id", "level", "internal_rank", "is_internal"], "left")


class Tree:
    """One sequence's tree in memory: counts of a symbol in any prefix."""

    def __init__(self, blocks: pd.DataFrame, leaves: pd.DataFrame, arity: int):
        self.arity = arity
        self.levels: dict[int, list[tuple]] = {}
        for level, start, size, internal, k, offset, rank in _lists(blocks.sort_values(["level", "blk"]), "level", "start", "block_size", "is_internal", "ptr_blk", "ptr_off", "internal_rank"):
            self.levels.setdefault(level, []).append((start, size, internal, None if k < 0 else (k, offset), rank))
        self.top = max(self.levels)
        self.leaves = [c for _, c in sorted(zip(leaves["leaf_blk"], leaves["content"], strict=True))]
        self.counts: dict[tuple[str, int, int], int] = {}
        self.sums: dict[str, list[int]] = {}

    def occurrences(self, content: str, symbol: str) -> int:
        return content.count(symbol)

    def children(self, level: int, blk: int) -> range:
        rank = self.levels[level][blk][4]
        return range(rank * self.arity, min((rank + 1) * self.arity, len(self.levels[level - 1])))

    def whole(self, symbol: str, level: int, blk: int) -> int:
        """How often the symbol occurs in a block."""
        key = (symbol, level, blk)
        if key not in self.counts:
            _, size, internal, pointer, rank = self.levels[level][blk]
            if not internal:
                k, offset = pointer
                n = self.whole(symbol, level, k) - self.prefix(symbol, level, k, offset)
                self.counts[key] = n + (self.prefix(symbol, level, k + 1, offset) if offset else 0)
            elif level == 0:
                self.counts[key] = self.occurrences(self.leaves[rank], symbol)
            else:
                self.counts[key] = sum(self.whole(symbol, level - 1, c) for c in self.children(level, blk))
        return self.counts[key]

    def prefix(self, symbol: str, level: int, blk: int, length: int) -> int:
        """How often the symbol occurs in the first length symbols of a block."""
        total = 0
        while length > 0:
            _, size, internal, pointer, rank = self.levels[level][blk]
            if not internal:
                k, offset = pointer
                total -= self.prefix(symbol, level, k, offset)
                if offset + length > size:
                    total += self.whole(symbol, level, k)
                    blk, length = k + 1, offset + length - size
                else:
                    blk, length = k, offset + length
                continue
            if level == 0:
                return total + self.occurrences(self.leaves[rank][:length], symbol)
            for c in self.children(level, blk):
                part = self.levels[level - 1][c][1]
                if length < part:
                    level, blk = level - 1, c
                    break
                total += self.whole(symbol, level - 1, c)
                length -= part
            else:
                return total
        return total

    def access(self, pos: int) -> str:
        """The symbol at a position of the text."""
        level, size = self.top, self.levels[self.top][0][1]
        blk, offset = divmod(pos, size)
        while True:
            _, size, internal, pointer, rank = self.levels[level][blk]
            if not internal:
                blk, offset = pointer[0], pointer[1] + offset
                if offset >= size:
                    blk, offset = blk + 1, offset - size
            elif level == 0:
                return self.leaves[rank][offset]
            else:
                level -= 1
                child, offset = divmod(offset, self.levels[level][0][1])
                blk = rank * self.arity + child

    def rank(self, symbol: str, length: int) -> int:
        """How often the symbol occurs in the first length symbols of the text."""
        size = self.levels[self.top][0][1]
        blk = min(length // size, len(self.levels[self.top]))
        sums = self.symbol_sums(symbol)
        return sums[blk] + (self.prefix(symbol, self.top, blk, length - blk * size) if blk < len(sums) - 1 else 0)

    def symbol_sums(self, symbol: str) -> list[int]:
        if symbol not in self.sums:
            out = [0]
            for blk in range(len(self.levels[self.top])):
                out.append(out[-1] + self.whole(symbol, self.top, blk))
            self.sums[symbol] = out
        return self.sums[symbol]

    def select(self, symbol: str, j: int) -> int | None:
        """The position of the j-th occurrence: the least prefix that holds j of them, found top level first."""
        sums = self.symbol_sums(symbol)
        if j < 1 or j > sums[-1]:
            return None
        blk = bisect_left(sums, j) - 1
        size = self.levels[self.top][0][1]
        low, high, need = 0, size, j - sums[blk]
        while high - low > 1:
            middle = (low + high) // 2
            if self.prefix(symbol, self.top, blk, middle) >= need:
                high = middle
            else:
                low = middle
        return blk * size + high - 1


def grouped(queries: DataFrame, blocks: DataFrame, leaves: DataFrame, arity: int, schema: str, answer: Callable[[Tree | None, pd.DataFrame], pd.DataFrame], kind: type[Tree] = Tree) -> DataFrame:
    """answer(tree or None, a sequence's queries) for each sequence with queries."""
    nodes = _with_content(blocks, leaves)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]
        if not len(left):
            return pd.DataFrame(columns=names)
        tree = None
        if len(right):
            content = right[(right["level"] == 0) & right["is_internal"]]
            tree = kind(right, pd.DataFrame({"leaf_blk": content["internal_rank"], "content": content["content"]}), arity)
        return answer(tree, left)[names]

    return spread(queries).groupBy("seq_id").cogroup(spread(nodes).groupBy("seq_id")).applyInPandas(run, schema)


def rank(queries: DataFrame, blocks: DataFrame, leaves: DataFrame, arity: int) -> DataFrame:
    """queries (seq_id, qid, sym, pos) with the rank of sym at pos, pos included; positions lie inside the text."""

    def answer(tree: Tree | None, rows: pd.DataFrame) -> pd.DataFrame:
        found = [tree.rank(s, int(p) + 1) if tree else None for s, p in zip(rows["sym"], rows["pos"], strict=True)]
        return rows.assign(rank=pd.array(found, "Int64"))

    return grouped(queries.select("seq_id", "qid", "sym", "pos"), blocks, leaves, arity, "seq_id long, qid long, sym string, pos long, rank long", answer)


def select(queries: DataFrame, blocks: DataFrame, leaves: DataFrame, arity: int) -> DataFrame:
    """queries (seq_id, qid, sym, j) with pos, the position of the j-th occurrence, or NULL."""

    def answer(tree: Tree | None, rows: pd.DataFrame) -> pd.DataFrame:
        found = [tree.select(s, int(j)) if tree else None for s, j in zip(rows["sym"], rows["j"], strict=True)]
        return rows.assign(pos=pd.array(found, "Int64"))

    return grouped(queries.select("seq_id", "qid", "sym", "j"), blocks, leaves, arity, "seq_id long, qid long, sym string, j long, pos long", answer)


def decoded(blocks: DataFrame, leaves: DataFrame, arity: int) -> DataFrame:
    """(seq_id, text): each sequence spelled out from its tree."""
    nodes = _with_content(blocks, leaves)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        spelled: list[str] = []
        for level in range(int(rows["level"].max()) + 1):
            here = rows[rows["level"] == level].sort_values("blk")
            now: list[str] = []
            for (size, internal, k, offset, rank), content in zip(_lists(here, "block_size", "is_internal", "ptr_blk", "ptr_off", "internal_rank"), here["content"].tolist(), strict=True):
                if not internal:
                    now.append((now[k] + (now[k + 1] if offset else ""))[offset : offset + size])
                elif level == 0:
                    now.append(content)
                else:
                    now.append("".join(spelled[rank * arity : (rank + 1) * arity]))
            spelled = now
        return pd.DataFrame({"seq_id": [int(rows["seq_id"].iloc[0])], "text": ["".join(spelled)]})

    return spread(nodes).groupBy("seq_id").applyInPandas(run, "seq_id long, text string")


def verify(sequences: DataFrame, blocks: DataFrame, leaves: DataFrame, arity: int) -> DataFrame:
    """(seq_id, symbols, ok) of each sequence with a text: its symbols, and whether its tree spells it."""
    spelled = decoded(blocks, leaves, arity).withColumnRenamed("text", "spelled")
    rows = sequences.where("text != ''").join(spelled, "seq_id", "left")
    return rows.select("seq_id", F.char_length("text").cast("long").alias("symbols"), F.col("text").eqNullSafe(F.col("spelled")).alias("ok"))


def verify_answers(sequences: DataFrame, blocks: DataFrame, leaves: DataFrame, arity: int) -> DataFrame:
    """(seq_id, checked, wrong_access, wrong_rank, wrong_select) of each sequence with a text: every position's symbol, that symbol's rank there, and where that occurrence is, asked of the tree."""

    def answer(tree: Tree | None, rows: pd.DataFrame) -> pd.DataFrame:
        text, wrong, seen = rows["text"].iloc[0], [0, 0, 0], {}
        for pos, symbol in enumerate(text):
            seen[symbol] = seen.get(symbol, 0) + 1
            wrong[0] += tree is None or tree.access(pos) != symbol
            wrong[1] += tree is None or tree.rank(symbol, pos + 1) != seen[symbol]
            wrong[2] += tree is None or tree.select(symbol, seen[symbol]) != pos
        return pd.DataFrame({"seq_id": rows["seq_id"].iloc[:1], "checked": len(text), "wrong_access": wrong[0], "wrong_rank": wrong[1], "wrong_select": wrong[2]})

    return grouped(sequences.where("text != ''").select("seq_id", "text"), blocks, leaves, arity, "seq_id long, checked long, wrong_access long, wrong_rank long, wrong_select long", answer)


def leaf_blocks(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """queries (seq_id, qid, pos) with blk, the leaf-level block that holds pos, NULL where a block above it refers back (its copy has no blocks below). Blocks start at multiples of their size, so one equi-join replaces the descent."""
    bottom = blocks.where("level = 0").select("seq_id", "start", "blk", "block_size")
    size = bottom.groupBy("seq_id").agg(F.max("block_size").alias("size"))
    asked = queries.join(size, "seq_id", "left").withColumn("start", F.col("pos") - F.col("pos") % F.col("size"))
    return asked.join(bottom.drop("block_size"), ["seq_id", "start"], "left").select("seq_id", "qid", "pos", "blk")
