"""Benchmark decontamination by spaced-seed hashing.

Words are lower-cased runs outside white space.  Each mask of MASKS takes the words at
its offsets, so a hash of them ignores the others: with these four, no stretch
of 15 words with 3 substitutions, or of 20 with 4, is without a hit.  Hashes of
training documents are joined with those of benchmark items; around a hit the two
texts are aligned, and the overlap counts if it holds a stretch of
at least LEAST_WORDS item words (the whole item if it is shorter) of which
AGREEMENT agree.  Items shorter than MASK_SPAN words have masks of their own: all their words, or all but one where
one may differ; items of TEN words have one mask more, as two of their words may differ in ways that MASKS miss.
Masks of lengths that no item has cost nothing.

The benchmark's words and hashes go to every task if they number at most
BROADCAST_WORDS (a checked bound): documents are then read once and nothing is shuffled.
A larger benchmark is joined by hash in a shuffle, after a bitmap of fixed size has
dropped the hashes that no item has.  Both ways give the same rows.

Defined results: null or empty texts are clean; items without words can't testify; an item without
an id contaminates, but isn't listed; an empty benchmark leaves all clean; repeated rows are
judged one by one; very long texts are handled alone; other columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._words import Words, mix, sliced, words_of
from ._work import as_row, batched, from_row, settled, table, with_added

#: Chosen by exhausting the substitution patterns named above.
MASKS = ((0, 2, 5, 6, 7), (0, 5, 6, 7, 8), (0, 1, 2, 4, 7), (0, 1, 5, 6, 8))
MASK_SPAN, TEN = 9, 10
MASK_OF_TEN = (0, 1, 3, 4, 5)
LEAST_WORDS, AGREEMENT = 15, 0.8
BROADCAST_WORDS = 2_000_000
BITMAP_BITS = 1 << 23
ADDED = "contaminated boolean, items array<long>, overlap_words long, agreement double"


def lowered(texts: list[str | None]) -> Words:
    return words_of([t and t.lower() for t in texts])


def masks_of(words: int) -> list[tuple[int, ...]]:
    """The masks that find an item of so many words."""
    if words >= MASK_SPAN:
        return [*MASKS, MASK_OF_TEN] if words == TEN else list(MASKS)
    whole = tuple(range(words))
    differ = words - math.ceil(AGREEMENT * words - 1e-9)
    return [whole[:k] + whole[k + 1 :] for k in whole] if differ else [whole] if words else []


def seeds(words: np.ndarray, masks: list[tuple[int, ...]]) -> Iterator[np.ndarray]:
    """Of each mask the hash at each position of a run of word hashes. A mask reaches to its last offset; that of an item whose last word may differ stands shorter."""
    for mask in masks:
        n = len(words) - mask[-1]
        if n > 0:
            h = np.full(n, hash_of_mask(mask), np.uint64)
            for offset in mask:
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[offset : offset + n])
            yield h


def hash_of_mask(mask: tuple[int, ...]) -> int:
    return sum(1 << offset for offset in mask)


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, float]:
    """The longest stretch of the item that counts as an overlap with doc words ``diagonal`` ahead: its words, and the share that agrees; (0, 0) if none."""
    low, high = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    need = min(LEAST_WORDS, len(item))
    if high - low < need:
        return 0, 0.0
    same = item[low:high] == doc[low + diagonal : high + diagonal]
    if same.sum() < AGREEMENT * need:
        return 0, 0.0
    # gain[j] - gain[i] >= 0: at least AGREEMENT of the words i..j-1 agree (in fifths, exactly).
    whole = round(AGREEMENT * 100)
    gain = np.concatenate(([0], np.cumsum(np.where(same, 100 - whole, -whole))))
    best = (0, 0.0)
    lowest = np.minimum.accumulate(gain)
    for j in range(len(gain) - 1, need - 1, -1):
        if j <= best[0]:
            break
        i = int(np.searchsorted(-lowest, -gain[j], side="left"))
        if j - i >= need and j - i > best[0]:
            best = (j - i, float(same[i:j].mean()))
    return best


class Benchmark:
    """Seeds of benchmark items, sorted, and the items' words."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in items]
        w = lowered([t for _, t in items])
        self.words = [w.hash[w.first[k] : w.first[k + 1]] for k in range(len(items))]
        keys, owner, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k, words in enumerate(self.words):
            for h in seeds(words, masks_of(len(words))):
                keys.append(h)
                owner.append(np.full(len(h), k))
                at.append(np.arange(len(h)))
        self.masks = all_masks(set(map(len, self.words)))
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        self.key, self.owner, self.at = key[order], np.concatenate(owner)[order], np.concatenate(at)[order]
        self.bitmap = bitmap_of(self.key)

    def judge(self, words: np.ndarray) -> tuple[bool, list[int], int, float]:
        """ADDED for one document's word hashes."""
        pairs: set[tuple[int, int]] = set()
        for h in seeds(words, self.masks):
            place = np.flatnonzero(in_bitmap(self.bitmap, h))
            if not len(place):
                continue
            first, last = np.searchsorted(self.key, h[place], "left"), np.searchsorted(self.key, h[place], "right")
            for p, a, b in zip(place.tolist(), first.tolist(), last.tolist(), strict=True):
                for k in range(a, b):
                    pairs.add((int(self.owner[k]), p - int(self.at[k])))
        found = [(*overlap(words, self.words[k], d), self.ids[k]) for k, d in pairs]
        return verdict([f for f in found if f[0]])


def all_masks(lengths: set[int]) -> list[tuple[int, ...]]:
    """The masks of items of all these lengths, each once."""
    return list(dict.fromkeys(mask for n in sorted(lengths, reverse=True) for mask in masks_of(n)))


def verdict(found: list[tuple[int, float, int | None]]) -> tuple[bool, list[int], int, float]:
    if not found:
        return False, [], 0, 0.0
    best = max(found, key=lambda f: (f[0], f[1]))
    return True, sorted({f[2] for f in found if f[2] is not None}), best[0], best[1]


def bitmap_of(keys: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITMAP_BITS // 8, np.uint8)
    k = keys >> np.uint64(41)  # 23 bits
    np.bitwise_or.at(bits, (k >> np.uint64(3)).astype(np.int64), np.uint8(1) << (k & np.uint64(7)).astype(np.uint8))
    return bits


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    k = keys >> np.uint64(41)
    return (bits[(k >> np.uint64(3)).astype(np.int64)] >> (k & np.uint64(7)).astype(np.uint8)) & 1 == 1


def annotate(docs: DataFrame, benchmark: DataFrame, most_words: int = BROADCAST_WORDS) -> DataFrame:
    """docs' rows (with a text) as ``row``, and ADDED."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    # Bytes over two bound the number of words.
    size = items.agg(F.coalesce(F.sum((F.octet_length("text") / 2).cast("long") + 1), F.lit(0))).first()[0]
    if size > most_words:
        return _joined(docs, items)
    held = Benchmark(sorted(map(tuple, items.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])))

    def judged(texts: list[str | None]) -> list[pa.Array]:
        w = lowered(texts)
        return _columns([held.judge(w.hash[w.first[k] : w.first[k + 1]]) for k in range(len(texts))])

    return with_added(docs, "text", ADDED, judged)


def _columns(found: list[tuple[bool, list[int], int, float]]) -> list[pa.Array]:
    return [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.bool_(), pa.list_(pa.int64()), pa.int64(), pa.float64()))]


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """annotate() for a benchmark of any size: seeds meet in a shuffle, then both texts of each alignment do."""
    rows = settled(docs.select(as_row(docs), F.col("text").alias("text"), F.monotonically_increasing_id().alias("n")), "docs")
    items = settled(items.withColumn("i", F.monotonically_increasing_id()), "items")

    lengths = items.select(F.size(F.array_remove(F.split("text", r"[ \x09-\x0D]+"), "")).alias("n")).where(F.col("n") <= TEN).distinct().collect()  # TEN + 1 rows at most
    masks = all_masks({r.n for r in lengths} | {MASK_SPAN})

    def seed_rows(bits: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
                for a, b in sliced(texts):
                    w = lowered(texts[a:b])
                    for k in range(b - a):
                        words = w.hash[w.first[k] : w.first[k + 1]]
                        for h in seeds(words, masks_of(len(words)) if bits is None else masks):
                            at = np.arange(len(h)) if bits is None else np.flatnonzero(in_bitmap(bits, h))
                            if len(at):
                                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), ids[a + k])), pa.array(h[at].view(np.int64)), pa.array(at)], ["id", "key", "at"])

        return run

    keys = settled(items.select("i", "text").mapInArrow(seed_rows(None), "id long, key long, at long"), "seeds")
    place = F.shiftrightunsigned("key", 41)
    words = keys.select(F.shiftright(place, 6).alias("w"), F.expr("shiftleft(1L, cast(shiftrightunsigned(key, 41) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    bits = np.zeros(BITMAP_BITS // 64, np.int64)  # at most so many rows come to the driver
    for w, b in words.collect():
        bits[w] = b
    hits = batched(rows.select("n", "text"), seed_rows(bits.view(np.uint8)), "id long, key long, at long")
    pairs = hits.join(keys.select("key", F.col("id").alias("i"), F.col("at").alias("item_at")), "key").select(F.col("id").alias("n"), "i", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    both = pairs.join(rows.select("n", "text"), "n").join(items.select("i", "item_id", F.col("text").alias("item")), "i")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, diagonal, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            doc_texts, item_texts = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            out = []
            for k in range(len(n)):
                w = lowered([doc_texts[k], item_texts[k]])
                size, share = overlap(w.hash[: w.first[1]], w.hash[w.first[1] :], diagonal[k])
                if size:
                    out.append((n[k], ids[k], size, share))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["n", "item_id", "size", "share"])

    found = batched(both.select("n", "diagonal", "item_id", "text", "item"), aligned, "n long, item_id long, size long, share double")
    found = found.groupBy("n").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max(F.struct("size", "share")).alias("best"))
    out = rows.select("row", "n").join(found, "n", "left")
    return out.select("row", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.coalesce("best.size", F.lit(0)).cast("long").alias("overlap_words"), F.coalesce("best.share", F.lit(0.0)).alias("agreement"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without an overlap, in all their columns."""
    return from_row(annotate(docs, benchmark).where("not contaminated"), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents, with the items that they overlap; all other documents are clean."""
    found = annotate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.where("contaminated").select(F.col("row.doc_id").cast("long").alias("doc_id"), "contaminated", "items", "overlap_words", "agreement")
