"""String-index arrays: suffix order, common prefixes, longest previous factors,
Lempel-Ziv phrases, nearest smaller values and range minima.

One sequence is one unit of work; sequences are spread over tasks by size, not
by count alone.  A position's longest previous factor is the longest prefix of its
suffix that also starts at an earlier position (they may overlap): the better of
the nearest earlier positions among the smaller and the larger suffixes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .symbols import bit_width


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): suffix starts in order, by prefix doubling; its inverse."""
    n = len(symbols)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        follow = np.zeros(n, np.int64)
        follow[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        if rank[order[-1]] == n - 1:
            return order, rank
        step *= 2


def lcp_array(symbols: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """lcp[r]: how many symbols the suffixes at ranks r - 1 and r share; 0 at rank 0."""
    n = len(symbols)
    text, start, where = symbols.tolist(), order.tolist(), rank.tolist()
    out, shared = [0] * n, 0
    for i in range(n):
        r = where[i]
        if r == 0:
            shared = 0
            continue
        j = start[r - 1]
        top = n - max(i, j)
        while shared < top and text[i + shared] == text[j + shared]:
            shared += 1
        out[r] = shared
        if shared:
            shared -= 1
    return np.array(out, np.int64)


def lpf_array(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, source) for each position; source -1 where the length is 0.

    Positions leave a doubly linked list of ranks from the last to the first, so the
    list's neighbours of a position are the nearest ranks with earlier positions.
    """
    n = len(order)
    up, down = np.arange(-1, n - 1).tolist(), np.arange(1, n + 1).tolist()
    shared, start = [*lcp.tolist(), 0], order.tolist()
    where = [0] * n
    for r, i in enumerate(start):
        where[i] = r
    length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    for i in range(n - 1, -1, -1):
        r = where[i]
        a, b = up[r], down[r]
        left, right = shared[r] if a >= 0 else 0, shared[b] if b < n else 0
        if max(left, right) > 0:
            length[i] = max(left, right)
            source[i] = start[a] if left >= right else start[b]
        if a >= 0:
            down[a] = b
        if b < n:
            up[b] = a
            shared[b] = min(left, right)
    return length, source


def lz_phrases(length: np.ndarray) -> list[int]:
    """Starts of the greedy phrases: each takes its longest previous factor, or one new symbol. The last phrase counts too."""
    out, at = [], 0
    while at < len(length):
        out.append(at)
        at += max(1, int(length[at]))
    return out


def nearest_smaller(values: list[float]) -> tuple[list[int], list[int]]:
    """For each index the nearest one to the left, and to the right, with a value not above its own; -1 if none."""
    n = len(values)
    left, right, stack = [-1] * n, [-1] * n, []
    for i in range(n):
        while stack and values[stack[-1]] > values[i]:
            stack.pop()
        left[i] = stack[-1] if stack else -1
        stack.append(i)
    stack = []
    for i in range(n - 1, -1, -1):
        while stack and values[stack[-1]] > values[i]:
            stack.pop()
        right[i] = stack[-1] if stack else -1
        stack.append(i)
    return left, right


class RangeMinimum:
    """Leftmost minima of ranges by doubling."""

    def __init__(self, values: np.ndarray):
        self.values, self.levels = np.asarray(values), [np.arange(len(values))]
        while 2 << (len(self.levels) - 1) <= len(values):
            a = self.levels[-1]
            step = 1 << (len(self.levels) - 1)
            x, y = a[:-step], a[step:]
            self.levels.append(np.where(self.values[x] <= self.values[y], x, y))

    def query(self, i: int, j: int) -> int:
        """The first position of the minimum of values[i..j], both ends included."""
        k = (j - i + 1).bit_length() - 1
        x, y = self.levels[k][i], self.levels[k][j - (1 << k) + 1]
        return int(x if self.values[x] <= self.values[y] else y)


def nullable(values: np.ndarray) -> pd.Series:
    """Whole numbers from 0; NULL for negative ones."""
    return pd.Series(pd.array(values, "Int64")).mask(values < 0)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def spread(df: DataFrame) -> DataFrame:
    """df dealt by seq_id to a given number of tasks: small texts are still much work, and Spark would merge them into one task."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "seq_id")


def per_sequence(sequences: DataFrame, schema: str, make: Callable[[int, str], pd.DataFrame | None]) -> DataFrame:
    """make() for each row of (seq_id, text), spread over tasks by seq_id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for seq_id, text in zip(batch["seq_id"], batch["text"], strict=True):
                found = make(seq_id, text)
                if found is not None and len(found):
                    yield found

    return spread(sequences.where("text is not null")).mapInPandas(run, schema)


def lpf_by_neighbours(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """lpf_array() composed of parts: the nearest ranks on both sides with earlier positions, and the least common prefix on the way to each."""
    n = len(order)
    length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    if not n:
        return length, source
    shared = RangeMinimum(lcp)
    for r, (a, b) in enumerate(zip(*nearest_smaller(order.tolist()), strict=True)):
        left = int(lcp[shared.query(a + 1, r)]) if a >= 0 else 0
        right = int(lcp[shared.query(r + 1, b)]) if b >= 0 else 0
        if max(left, right) > 0:
            length[order[r]] = max(left, right)
            source[order[r]] = order[a] if left >= right else order[b]
    return length, source


def lpf_by_stack(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """lpf_array() in one pass over the ranks: waiting positions ascend, each with what it shares with the one beneath; an earlier position settles the later ones above it."""
    n = len(order)
    length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    waiting: list[tuple[int, int]] = []
    for now, common in [*zip(order.tolist(), lcp.tolist(), strict=True), (-1, 0)]:
        while waiting and waiting[-1][0] > now:
            at, beneath = waiting.pop()
            if max(beneath, common) > 0:
                length[at] = max(beneath, common)
                source[at] = waiting[-1][0] if beneath >= common else now
            common = min(common, beneath)
        waiting.append((now, common))
    return length, source


def index_arrays(sequences: DataFrame, lpf: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] = lpf_array) -> DataFrame:
    """(seq_id, pos, rank, lcp, lpf, src): of each position its suffix's rank, the common prefix with the suffix before in order, the longest previous factor and where it is (NULL if none)."""

    def make(seq_id: int, text: str) -> pd.DataFrame | None:
        if not text:
            return None
        points = code_points(text)
        order, rank = suffix_array(points)
        lcp = lcp_array(points, order, rank)
        length, source = lpf(order, lcp)
        return pd.DataFrame({"seq_id": seq_id, "pos": np.arange(len(points)), "rank": rank, "lcp": lcp[rank], "lpf": length, "src": nullable(source)})

    return per_sequence(sequences, "seq_id long, pos long, rank long, lcp long, lpf long, src long", make)


def lz_factors(sequences: DataFrame) -> DataFrame:
    """(seq_id, k, pos, len, src) of the greedy phrases."""

    def make(seq_id: int, text: str) -> pd.DataFrame | None:
        if not text:
            return None
        points = code_points(text)
        order, rank = suffix_array(points)
        length, source = lpf_array(order, lcp_array(points, order, rank))
        at = np.array(lz_phrases(length))
        return pd.DataFrame({"seq_id": seq_id, "k": np.arange(len(at)), "pos": at, "len": np.maximum(length[at], 1), "src": nullable(source[at])})

    return per_sequence(sequences, "seq_id long, k long, pos long, len long, src long", make)


def repeat_spans(sequences: DataFrame, least: int) -> DataFrame:
    """(seq_id, pos, len, src): positions at which a repeat of an earlier part, of ``least`` symbols or more, begins and doesn't just continue the one before."""

    def make(seq_id: int, text: str) -> pd.DataFrame | None:
        if not text:
            return None
        points = code_points(text)
        order, rank = suffix_array(points)
        length, source = lpf_array(order, lcp_array(points, order, rank))
        before = np.concatenate(([0], length[:-1]))
        at = np.flatnonzero((length >= least) & (length >= before))
        return pd.DataFrame({"seq_id": seq_id, "pos": at, "len": length[at], "src": source[at]})

    return per_sequence(sequences, "seq_id long, pos long, len long, src long", make)


def nearest_smaller_values(rows: DataFrame) -> DataFrame:
    """(seq_id, pos, value) with ``left_pos`` and ``right_pos``, the nearest positions with a value not above; NULL if none."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos", ignore_index=True)
        at = group["pos"].to_numpy()
        left, right = (np.array(x) for x in nearest_smaller(group["value"].tolist()))
        for name, k in (("left_pos", left), ("right_pos", right)):
            group[name] = nullable(np.where(k >= 0, at[np.maximum(k, 0)], -1))
        return group[["seq_id", "pos", "value", "left_pos", "right_pos"]]

    return rows.where("value is not null").select("seq_id", "pos", "value").groupBy("seq_id").applyInPandas(run, "seq_id long, pos long, value double, left_pos long, right_pos long")


def range_minima(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """queries (seq_id, qid, i, j) with the minimum of the values at positions i..j and its leftmost position.

    Minima of stretches of 1, 2, 4, ... rows are made by doubling, and a range is two stretches that may overlap: an
    equi-join, so the work grows with rows times the logarithm of the longest range. Positions have no gaps.
    """
    longest = queries.agg(F.max(F.col("j") - F.col("i") + 1)).first()[0] or 1
    by, levels = Window.partitionBy("seq_id").orderBy("pos"), max(1, int(longest).bit_length())
    stretches = rows.select("seq_id", "pos", F.struct("value", "pos").alias("m0"))
    for k in range(1, levels):
        stretches = stretches.withColumn(f"m{k}", F.least(f"m{k - 1}", F.lead(f"m{k - 1}", 1 << (k - 1)).over(by)))
    stretches = stretches.select("seq_id", F.col("pos").alias("at"), F.posexplode(F.array(*[f"m{k}" for k in range(levels)])).alias("k", "m"))
    asked = queries.where("i <= j").select("seq_id", "qid", "i", "j", (bit_width(F.col("j") - F.col("i") + 1) - 1).cast("int").alias("k"))
    asked = asked.withColumn("at", F.explode(F.array(F.col("i"), F.expr("j - shiftleft(1L, k) + 1"))))
    found = asked.join(stretches, ["seq_id", "k", "at"]).groupBy("seq_id", "qid", "i", "j").agg(F.min("m").alias("m"))
    return found.select("seq_id", "qid", "i", "j", F.col("m.value").alias("value"), F.col("m.pos").alias("pos"))


def sliding_minima(rows: DataFrame, width: int) -> DataFrame:
    """(seq_id, pos, value, min_pos): the leftmost minimum of the last ``width`` rows of each position."""
    by = Window.partitionBy("seq_id").orderBy("pos").rowsBetween(1 - width, 0)
    m = F.min(F.struct("value", "pos")).over(by)
    return rows.select("seq_id", "pos", m["value"].alias("value"), m["pos"].alias("min_pos"))
