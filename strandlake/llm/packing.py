"""Packing token sequences into windows by order-preserving dynamic programming.

The token streams of consecutive documents are joined in order and cut into
windows of at most MAX_TOKENS tokens.  A cut may lie at a document's end (free),
at a sentence's end (SENTENCE_PENALTY) or on a grid inside a sentence
(HARD_PENALTY); a window costs its padding, the penalty of its right cut and
WINDOW_PENALTY, which keeps windows from being small powers of two throughout.
Windows are padded to MAX_TOKENS, except that one whose length is a power of
two needs none.  With ``f(j) = min f(i) + MAX - (p_j - p_i) + penalty_j`` over the
cuts i within MAX_TOKENS before j, the best i is the minimum of ``f(i) + p_i`` in a
sliding range: a monotone queue gives it in constant time; the ten
powers of two are looked up by position.

Documents are packed in the order of the input partition, in blocks of about
BLOCK_TOKENS tokens; the last window of a block is carried into the next one, so
memory is bounded by a block and one document.  Every task packs its own
partition; there is no shuffle.

Ids are those of the tokenizer file: texts are split at its added tokens, what lies
between is encoded by a faster form of the same vocabulary, or by the file itself
where that form gives up (a million white-space characters in a row).

Defined results: a null text is an empty one (one token, the separator);
repeated ids are packed as often as they occur; an empty table gives no pieces.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._words import sliced
from ._work import batched, table

MAX_TOKENS = 1024
SEPARATOR = 0
GRID = 64
SENTENCE_PENALTY, HARD_PENALTY, WINDOW_PENALTY = 2.0, 12.0, 16.0
BLOCK_TOKENS = 1 << 18
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padding long"


class Encoder:
    """The ids that the tokenizer file ``tokenizer`` gives, most of them by tiktoken from the rank file ``vocabulary`` of the same BPE."""

    def __init__(self, vocabulary: str, tokenizer: str):
        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        with open(tokenizer, encoding="utf-8") as file:
            added = json.load(file)["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError(f"{tokenizer}: added tokens that take more than their own text")
        self.added = {t["content"]: t["id"] for t in added}
        # The longest of those that start at a place wins.
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if added else lambda text: [text]
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.tokenizer, self._slow = tokenizer, None
        #: Which ids end a sentence or line.
        self.ends = np.zeros(max(*ranks.values(), *self.added.values()) + 1, bool)
        for token, k in ranks.items():
            self.ends[k] = token.rstrip(b"\"')")[-1:] in (b".", b"!", b"?", b"\n")

    def slow(self, text: str) -> list[int]:
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.tokenizer)
        return self._slow.encode(text, add_special_tokens=False).ids

    def _plain(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # the pattern's backtracking is limited
            return np.array(self.slow(text), np.uint32)

    def __call__(self, text: str) -> np.ndarray:
        parts = self.split(text)
        if len(parts) == 1:
            return self._plain(text)
        return np.concatenate([np.array([self.added[p]], np.uint32) if k % 2 else self._plain(p) for k, p in enumerate(parts)])


@lru_cache(maxsize=2)
def encoder(vocabulary: str, tokenizer: str) -> Encoder:
    return Encoder(vocabulary, tokenizer)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def best_cuts(position: np.ndarray, penalty: np.ndarray, most: int = MAX_TOKENS) -> list[int]:
    """Indices into position (ascending, from 0, gaps at most ``most``) of the windows' right ends, of least cost."""
    at, extra = position.tolist(), penalty.tolist()
    n = len(at)
    cost, back = [0.0] * n, [0] * n
    where = {p: i for i, p in enumerate(at)}
    powers = [1 << k for k in range(most.bit_length()) if 1 << k < most]
    queue: deque[tuple[float, int]] = deque()
    for j in range(1, n):
        # Cut j - 1 enters the queue; dominated ones leave at the right.
        value = cost[j - 1] + at[j - 1]
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j - 1))
        p = at[j]
        low = p - most
        while at[queue[0][1]] < low:
            queue.popleft()
        value, i = queue[0]
        value += most - p
        for length in powers:
            k = where.get(p - length)
            if k is not None and cost[k] < value:
                value, i = cost[k], k
        cost[j], back[j] = value + extra[j] + WINDOW_PENALTY, i
    out, j = [], n - 1
    while j > 0:
        out.append(j)
        j = back[j]
    return out[::-1]


def cut_positions(tokens: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Candidate cuts of a block of tokens and their penalties. last: nothing follows, so the tail may be split into powers of two."""
    n = len(tokens)
    penalty = np.full(n + 1, np.inf)
    penalty[GRID::GRID] = HARD_PENALTY
    if last:
        tail = n % MAX_TOKENS
        for k in range(MAX_TOKENS.bit_length()):
            penalty[n - tail % (1 << k)] = HARD_PENALTY
    penalty[1:][sentence_end[tokens]] = SENTENCE_PENALTY
    penalty[doc_ends] = 0.0
    penalty[0] = penalty[n] = 0.0
    position = np.flatnonzero(np.isfinite(penalty))
    return position, penalty[position]


class Packer:
    """Takes documents in order and gives pieces: the rows of SCHEMA as tuples."""

    def __init__(self, sentence_end: np.ndarray, first_sequence: int):
        self.sentence_end, self.sequence = sentence_end, first_sequence
        self.parts: list[tuple[int | None, int, int, np.ndarray]] = []  # doc_id, its tokens before, its tokens in all, tokens
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        self.parts.append((doc_id, 0, len(ids), ids))
        self.held += len(ids)
        if self.held >= BLOCK_TOKENS:
            yield from self._flush(False)

    def finish(self) -> Iterator[tuple]:
        if self.held:
            yield from self._flush(True)

    def _flush(self, last: bool) -> Iterator[tuple]:
        tokens = np.concatenate([p[3] for p in self.parts])
        doc_ends = np.cumsum([len(p[3]) for p in self.parts])
        position, penalty = cut_positions(tokens, doc_ends, self.sentence_end, last)
        ends = [int(position[j]) for j in best_cuts(position, penalty)]
        if not last and len(ends) > 1:
            ends.pop()
        done, k = 0, 0
        kept: list[tuple[int | None, int, int, np.ndarray]] = []
        starts = doc_ends - [len(p[3]) for p in self.parts]
        for end in ends:
            size, at = end - done, done
            padding = 0 if size & (size - 1) == 0 else MAX_TOKENS - size
            while at < end:
                doc_id, before, total, ids = self.parts[k]
                a = at - int(starts[k])
                b = min(len(ids), end - int(starts[k]))
                yield doc_id, before + a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()), total, self.sequence, at - done, size, padding
                at += b - a
                if b == len(ids):
                    k += 1
            done = end
            self.sequence += 1
        for doc_id, before, total, ids in self.parts[k:]:
            a = max(0, done - int(starts[k]))
            kept.append((doc_id, before + a, total, ids[a:]))
            k += 1
        self.parts, self.held = kept, len(tokens) - done


def pack(docs: DataFrame, vocabulary: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all rows of docs (doc_id, text): SCHEMA. Sequence ids are unique: the partition's number and a counter."""
    files = vocabulary or vocabulary_path(), tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer: Packer | None = None
        schema = pa.schema([(name, pa.int64()) for name in (c.split()[0] for c in SCHEMA.split(", "))])

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

        encode = encoder(*files)
        rows: list[tuple] = []
        for batch in batches:
            texts, ids, parts = batch.column(1).to_pylist(), batch.column(0).to_pylist(), batch.column(2)
            if packer is None and len(ids):
                packer = Packer(encode.ends, parts[0].as_py() << 40)
            for a, b in sliced(texts):
                for doc_id, text in zip(ids[a:b], texts[a:b], strict=True):
                    rows += packer.add(doc_id, np.append(encode(text or ""), SEPARATOR).astype(np.uint32))
                if len(rows) > 20_000:
                    yield batch_of(rows)
                    rows = []
        if packer is not None:
            rows += packer.finish()
        if rows:
            yield batch_of(rows)

    return batched(docs.select(F.col("doc_id").cast("long"), "text", F.spark_partition_id().alias("part")), run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
