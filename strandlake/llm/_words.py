"""Word fingerprints for batches of texts, vectorised over the UTF-8 bytes.

A word is a maximal run of bytes outside space and \\x09-\\x0D.  Its
fingerprint has 64 bits: of a word of at most LONG bytes, its bytes by eights through a bijective mixer; of a longer
one, its BLAKE2 digest.  Runs of words are joined from their halves through the same mixer.  Nothing is a sum or a
polynomial, so texts of much structure (of two alternating words, say) collide no more often than random ones.
Equal words have equal fingerprints in every batch, task and run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes of text handled at once; a longer single text is handled alone.
SLICE_BYTES = 1 << 17
#: Bytes of the longest word that is hashed by eights.
LONG = 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The fingerprints of runs of which a and b are the fingerprints of the parts."""
    return mix(a * _STEP + b)


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Fingerprint of values[starts:ends] for each non-empty span: of its length and of two runs that cover it, whose length is a power of two."""
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64(seed))
    runs, step = values, 1
    most = int(size.max(initial=0))
    while step <= most:
        here = np.flatnonzero((size >= step) & (size < 2 * step))
        if len(here):
            out[here] = joined(joined(out[here], runs[starts[here]]), runs[ends[here] - step])
        if 2 * step <= most:
            runs = joined(runs[:-step], runs[step:])
        step *= 2
    return out


def bytes_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprint of the bytes data[start:end] of each span."""
    size = end - start
    out = mix(size.astype(np.uint64))
    eights = np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))).data, 0, (1,))
    here = np.flatnonzero(size <= LONG)
    for at in range(0, LONG, 8):
        here = here[size[here] > at] if at else here
        if not len(here):
            break
        left = np.minimum(size[here] - at, 8).astype(np.uint64)
        part = eights[start[here] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8)))
        out[here] = mix(out[here] ^ part)
    raw = data.data
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(raw[start[k] : end[k]], digest_size=8).digest(), "little")
    return out


@dataclass
class Words:
    """The words of some texts; all arrays but first and n_bytes have one entry a word."""

    data: np.ndarray  # the bytes, texts joined by newlines
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each text: its first word; one entry more than texts
    text_at: np.ndarray  # of each text: its first byte; one entry more than texts


def windows(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Fingerprints of all runs of width hashes; none if there are fewer. Another seed gives independent ones."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    runs, step, at = mix(hashes + np.uint64(seed)), 1, 0
    out = np.full(n, np.uint64(width))
    while step <= width:
        if width & step:
            out = joined(out, runs[at : at + n])
            at += step
        if 2 * step <= width:
            runs = joined(runs[:-step], runs[step:])
        step *= 2
    return out


def words_of(texts: list[str | None], lower: bool = False) -> Words:
    """lower: A-Z count as a-z. A null text has no words."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    whole = b"\n".join(parts) + b"\n"
    if lower:
        whole = whole.lower()
    data = np.frombuffer(whole, np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate(([True], space)).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    text_at = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts]))).astype(np.int64)
    return Words(data, start, end, bytes_hash(data, start, end), np.searchsorted(start, text_at), text_at)


def sliced(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE_BYTES each."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > begin and size + n > SLICE_BYTES:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)
