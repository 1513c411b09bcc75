"""Recompression of word sequences, with the context that each symbol depends on.

A round names runs (equal neighbours become one symbol, named by symbol and
count) and then pairs (symbols are split in two halves by a bit of their name, and a
left symbol followed by a right one become one symbol).  A name is the fingerprint
of what it stands for, so it is the same in all documents and tasks without a
dictionary that all rounds share.

Besides the words it covers, a symbol has a context: the words that fix how it was
parsed.  Wherever these words occur, the symbol occurs.  So equal windows hold
equal symbols inside, and the choice of one of them (of the highest level, then
of the smallest name, then the first) is the same for equal windows, whatever stands
around.  Windows that choose a symbol hold its context too, so the context's
fingerprint stands for it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ._words import mix, spans_hash

ROUNDS = 6

@dataclass
class Level:
    """Symbols in order; low and high bound the words of the context (high is exclusive)."""

    name: np.ndarray
    low: np.ndarray
    high: np.ndarray
    text: np.ndarray
    first: np.ndarray  # of each text: its first word; one entry more than texts


def words_level(words: np.ndarray, first: np.ndarray) -> Level:
    n = len(words)
    at = np.arange(n, dtype=np.int64)
    return Level(mix(words ^ np.uint64(0x51ED270B7A1F3C55)), at, at + 1, np.repeat(np.arange(len(first) - 1), np.diff(first)), first)


def _neighbours(level: Level) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether a symbol and the next are of one text; the low of the one before and the high of the next (one beyond the text where there is none, which no window reaches)."""
    joined = level.text[1:] == level.text[:-1]
    before, after = level.first[level.text] - 1, level.first[level.text + 1] + 1
    before[1:][joined] = level.low[:-1][joined]
    after[:-1][joined] = level.high[1:][joined]
    return joined, before, after


def runs_named(level: Level) -> Level:
    joined, before, after = _neighbours(level)
    start = np.flatnonzero(np.concatenate(([True], ~(joined & (level.name[1:] == level.name[:-1])))))
    last = np.concatenate((start[1:], [len(level.name)])) - 1
    count = (last - start + 1).astype(np.uint64)
    name = level.name[start]
    name = np.where(count > 1, mix(name * np.uint64(0xD6E8FEB86659FD93) + count), name)
    return Level(name, np.minimum(before[start], level.low[start]), np.maximum(after[last], level.high[last]), level.text[start], level.first)


def pairs_named(level: Level, k: int) -> Level:
    joined, before, after = _neighbours(level)
    right = (mix(level.name + np.uint64(k + 1)) & np.uint64(1)).astype(bool)
    merged = joined & ~right[:-1] & right[1:]
    head = np.concatenate((merged, [False]))
    tail = np.concatenate(([False], merged))
    # A left symbol may only join the next one, a right symbol only the one before.
    low = np.where(right, np.minimum(before, level.low), level.low)
    high = np.where(right, level.high, np.maximum(after, level.high))
    name = level.name.copy()
    at = np.flatnonzero(head)
    name[at] = mix(name[at] * np.uint64(0xA0761D6478BD642F) + mix(name[at + 1] + np.uint64(0xE7037ED1A0B428DB)))
    low[at], high[at] = level.low[at], level.high[at + 1]
    keep = ~tail
    return Level(name[keep], low[keep], high[keep], level.text[keep], level.first)


def levels(words: np.ndarray, first: np.ndarray, width: int, rounds: int = ROUNDS) -> list[Level]:
    """Level 0 (words) and the level after each round, while some context fits in width words."""
    out = [words_level(words, first)]
    if not len(words):
        return out
    for k in range(rounds):
        level = out[-1]
        if k % 2 == 0:
            level = runs_named(level)
        level = pairs_named(level, k)
        if not (level.high - level.low <= width).any():
            break
        out.append(level)
    return out


def _smallest(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where values[a:b] is smallest, for each non-empty range; the first of equal ones."""
    size = b - a
    out = np.empty(len(a), np.int64)
    best, step = np.arange(len(values)), 1
    while True:
        here = np.flatnonzero((size >= step) & (size < 2 * step))
        left, right = best[a[here]], best[b[here] - step]
        out[here] = np.where(values[left] <= values[right], left, right)
        if step * 2 > size.max(initial=0):
            return out
        left, right = best[:-step], best[step:]
        best = np.where(values[left] <= values[right], left, right)
        step *= 2


def anchors(words: np.ndarray, first: np.ndarray, width: int, rounds: int = ROUNDS) -> np.ndarray:
    """For each word at which a window of width words of one text starts: a fingerprint of the symbol chosen in it and of its context; 0 for other words."""
    out = np.zeros(len(words), np.uint64)
    ends = np.repeat(first[1:], np.diff(first))
    open_at = np.flatnonzero(np.arange(len(words)) + width <= ends)
    for k, level in reversed(list(enumerate(levels(words, first, width, rounds)))):
        if not len(open_at):
            break
        a, b = np.searchsorted(level.low, open_at, "left"), np.searchsorted(level.high, open_at + width, "right")
        has = b > a
        chosen, which = np.unique(_smallest(mix(level.name), a[has], b[has]), return_inverse=True)
        # A fingerprint of one level says nothing of another's.
        out[open_at[has]] = spans_hash(words, level.low[chosen], level.high[chosen], k + 1)[which] | np.uint64(1)
        open_at = open_at[~has]
    return out
