"""Polynomial fingerprints modulo Mersenne primes.

The fingerprint of a byte string is ``sum b[k] * 256**(n-1-k) mod P``: the string read
as a big-endian number, modulo P.  For P = 2**61 - 1 multiplying by 256 rotates
61 bits by 8, so windows of any width are hashed with shifts alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

P61, P107 = (1 << 61) - 1, (1 << 107) - 1
_M = np.uint64(P61)


def poly_hash(content: bytes, modulus: int = P61, base: int = 256) -> int:
    """base 256: of bytes; base 2: of bits, given as bytes 0 and 1."""
    if base == 256:
        return int.from_bytes(content, "big") % modulus
    return int("".join(map(str, content)) or "0", base) % modulus


def poly_hash_column(text: Column, modulus: int = P61) -> Column:
    """The fingerprint of a text's UTF-8 bytes: BIGINT below 2**63, else DECIMAL(38, 0)."""
    from decimal import Decimal

    small = modulus < 1 << 63

    @F.pandas_udf(T.LongType() if small else T.DecimalType(38, 0))
    def run(texts: pd.Series) -> pd.Series:
        values = [None if t is None else poly_hash(t.encode(), modulus) for t in texts]
        return pd.Series(values, dtype="Int64") if small else pd.Series([None if v is None else Decimal(v) for v in values], dtype=object)

    return run(text)


def window_values(content: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints modulo 2**61 - 1 of all windows of width bytes; none if there are fewer."""
    n = len(content) - width + 1
    if n <= 0 or width < 1:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = ((h << np.uint64(8)) & _M) + (h >> np.uint64(53)) + content[k : k + n]
        h = (h & _M) + (h >> np.uint64(61))
    return np.where(h == _M, np.uint64(0), h)


_BASE = 0xD1342543DE82EF95


def window_keys(points: np.ndarray, width: int) -> np.ndarray:
    """64-bit keys of all windows of width symbols, in time that doesn't depend on the width. Equal windows have equal keys; whoever needs certainty compares contents."""
    n = len(points) - width + 1
    if n <= 0 or width < 1:
        return np.empty(0, np.uint64)
    up, down = (np.cumprod(np.full(len(points), b, np.uint64), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    key = (total[width:] - total[:-width]) * down[:n]
    key ^= key >> np.uint64(29)
    return key * np.uint64(0x9FB21C651E98DF25)


def leftmost(text: str, points: np.ndarray, width: int, wanted: np.ndarray, allowed: np.ndarray | None = None) -> np.ndarray:
    """For each wanted start the leftmost (allowed) start of a window with the same content; -1 if there is none. allowed: ascending starts of whole windows."""
    keys = window_keys(points, width)
    at = np.arange(len(keys)) if allowed is None else allowed
    if not len(at) or not len(wanted):
        return np.full(len(wanted), -1, np.int64)
    known, first = np.unique(keys[at], return_index=True)
    place = np.minimum(np.searchsorted(known, keys[wanted]), len(known) - 1)
    found = np.where(known[place] == keys[wanted], at[first[place]], -1)
    for k, (a, b) in enumerate(zip(found.tolist(), wanted.tolist(), strict=True)):
        if a >= 0 and a != b and text[a : a + width] != text[b : b + width]:
            part = text[b : b + width]
            found[k] = next((i for i in at.tolist() if text[i : i + width] == part), -1)
    return found


def bit_window_values(bits: np.ndarray, width: int) -> np.ndarray:
    """The same for bits with base 2."""
    n = len(bits) - width + 1
    if n <= 0 or width < 1:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = ((h << np.uint64(1)) & _M) + (h >> np.uint64(60)) + bits[k : k + n]
        h = (h & _M) + (h >> np.uint64(61))
    return np.where(h == _M, np.uint64(0), h)


def bit_slice(packed: np.ndarray, i: int) -> int:
    """Bits i..i+63 of packed bytes (lowest bit first) as a number, zeros beyond the end."""
    part = int.from_bytes(packed[i // 8 : i // 8 + 9].tobytes(), "little") >> (i % 8)
    return part & (1 << 64) - 1


def window_hashes(sequences: DataFrame, width: int) -> DataFrame:
    """(seq_id, pos, hash) of all windows of width bytes of (seq_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for seq_id, text in zip(batch["seq_id"], batch["text"], strict=True):
                h = window_values(np.frombuffer(text.encode(), np.uint8), width)
                if len(h):
                    yield pd.DataFrame({"seq_id": seq_id, "pos": np.arange(len(h)), "hash": h.astype(np.int64)})

    return sequences.where("text is not null").mapInPandas(run, "seq_id long, pos long, hash long")


def same_content(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """pairs (seq_id, a, b, length) with whether text[a..] and text[b..] agree for length symbols, exactly."""
    rows = pairs.join(sequences, "seq_id")
    part = lambda at: F.substring("text", (F.col(at) + 1).cast("int"), F.col("length").cast("int"))
    return rows.select("seq_id", "a", "b", "length", ((part("a") == part("b")) & (F.greatest("a", "b") + F.col("length") <= F.char_length("text"))).alias("same"))
