"""Quality classifier: a factorisation machine.

Inputs of a score, all from the text alone: counts of hashed words (BUCKETS
columns), and statistics of structure and length.  The model is
``w0 + <w, x> + sum over i<j of <v_i, v_j> x_i x_j``, and the pairwise sum is
``(|sum v_i x_i|**2 - sum |v_i|**2 x_i**2) / 2``, linear in the inputs.

Defined results: a null or empty text is scored from its (zero) statistics;
without labels of both kinds every score is the share of label 1 (0.5 without
any label); repeated labels count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._words import sliced, words_of
from ._work import batched, crc_mod, from_row, table, with_added

BUCKETS, RANK = 2048, 8
#: Bound of the training sample: labelled rows of each label, chosen by a hash of doc_id.
SAMPLE_ROWS = 3000
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 64, 0.02, 1e-5, 7
KEEP_AT = 0.3

_CLASS = np.zeros(256, np.int64)
_CLASS[:] = 1  # other ASCII signs
_CLASS[128:] = 0  # parts of longer characters
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c\r", b"\n", b".,;:'-", b"!?", b"#$%&*@^~", b"|/\\_<>{}[]()=+"), 2):
    _CLASS[list(_bytes)] = _k
CLASSES = 11
STATISTICS = CLASSES + 6


def features(texts: list[str | None]) -> np.ndarray:
    """One row a text: hashed words, then statistics."""
    n = len(texts)
    w = words_of(texts)
    per_text = np.diff(w.first)
    owner = np.repeat(np.arange(n), per_text)
    counts = np.bincount(owner * BUCKETS + (w.hash % np.uint64(BUCKETS)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)
    distinct = (counts > 0).sum(1)
    words = np.log1p(counts)
    words /= np.maximum(np.sqrt((words * words).sum(1, keepdims=True)), 1e-6)
    size = np.diff(w.text_at)
    byte_owner = np.repeat(np.arange(n), size)
    kinds = np.bincount(byte_owner * CLASSES + _CLASS[w.data], minlength=n * CLASSES).reshape(n, CLASSES).astype(np.float32)
    kinds[:, 6] -= 1  # the newline that joins texts
    chars = np.maximum(size - 1, 1)[:, None]
    length = np.maximum(per_text, 1)
    long_words = np.bincount(owner, weights=(w.end - w.start) > 20, minlength=n) / length
    word_bytes = np.bincount(owner, weights=w.end - w.start, minlength=n) / length
    # Lines that occur before in the same text: repetition.
    repeated = np.array([1 - len(set(lines)) / len(lines) if (lines := (t or "").split("\n")) else 0.0 for t in texts])
    rest = np.stack([np.log1p(per_text) / 8, np.log1p(size) / 10, word_bytes / 10, long_words, distinct / np.minimum(length, BUCKETS), repeated], 1)
    return np.concatenate([words, np.sqrt(kinds / chars), rest], 1).astype(np.float32)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) * self.scale, -8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        x = self.scaled(x)
        pairs = ((x @ self.factors) ** 2 - (x * x) @ (self.factors**2)).sum(1) / 2
        return 1 / (1 + np.exp(-np.clip(self.bias + x @ self.linear + pairs, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Machine:
    """Adam on the logistic loss, each label with half of the weight mixed with its share."""
    width = BUCKETS + STATISTICS
    share = float(y.mean()) if len(y) else 0.5
    mean, scale = np.zeros(width, np.float32), np.ones(width, np.float32)
    if len(y):
        mean[BUCKETS:], scale[BUCKETS:] = x[:, BUCKETS:].mean(0), 1 / np.maximum(x[:, BUCKETS:].std(0), 1e-3)
        scale[:BUCKETS] = 2.0
    draw = np.random.default_rng(SEED)
    m = Machine(float(np.log(max(share, 1e-3) / max(1 - share, 1e-3))), np.zeros(width, np.float32), draw.normal(0, 0.01, (width, RANK)).astype(np.float32), mean, scale)
    if share in (0.0, 1.0) or not len(y):
        m.factors[:] = 0
        return m
    m.bias = 0.0
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    x = m.scaled(x)
    parameters = [np.zeros(1, np.float32), m.linear, m.factors]
    first, second, t = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters], 0
    for _ in range(EPOCHS):
        order = draw.permutation(len(y))
        for at in range(0, len(y), BATCH):
            k = order[at : at + BATCH]
            b = x[k]
            s = b @ parameters[2]
            z = parameters[0] + b @ parameters[1] + (s * s - (b * b) @ parameters[2] ** 2).sum(1) / 2
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[k]) * weight[k] / len(k)
            grads = [g.sum(keepdims=True), b.T @ g + DECAY * parameters[1], b.T @ (g[:, None] * s) - parameters[2] * ((b * b).T @ g)[:, None] + DECAY * parameters[2]]
            t += 1
            for p, d, u, v in zip(parameters, grads, first, second, strict=True):
                u += 0.1 * (d - u)
                v += 0.01 * (d * d - v)
                p -= RATE * 0.5 * (u / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
    m.bias = float(parameters[0][0])
    return m


def learn(docs: DataFrame, labels: DataFrame) -> Machine:
    """From at most SAMPLE_ROWS labelled rows of each label; what reaches the driver is their hashed inputs."""
    given = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
    first = [given.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS) for k in (0, 1)]
    sample = first[0].unionByName(first[1])
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample), "doc_id")
    # Of rows with one doc_id the smallest text: no more than the sample comes to the driver.
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in sliced(texts):
                x = features(texts[a:b])
                at = [np.flatnonzero(r) for r in x]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[a:b], batch.column(2)[a:b], pa.array([i.astype("<u2").tobytes() for i in at], pa.binary()), pa.array([r[i].astype("<f4").tobytes() for r, i in zip(x, at, strict=True)], pa.binary())],
                    ["doc_id", "quality", "at", "value"],
                )

    got = sorted(map(tuple, batched(rows.select("text", "doc_id", "quality"), run, "doc_id long, quality int, at binary, value binary").collect()))
    x = np.zeros((len(got), BUCKETS + STATISTICS), np.float32)
    for i, (_, _, at, value) in enumerate(got):
        x[i, np.frombuffer(at, "<u2")] = np.frombuffer(value, "<f4")
    return fit(x, np.array([g[1] for g in got], np.float32))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in sliced(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(machine.score(features(texts[a:b])).astype(float), pa.float64())], ["doc_id", "score"])

    return batched(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double")


def kept(docs: DataFrame, machine: Machine, least: float = KEEP_AT) -> DataFrame:
    """The rows of docs whose text scores ``least`` or more, in all their columns."""
    scored = with_added(docs, "text", "score double", lambda texts: [pa.array(machine.score(features(texts)).astype(float), pa.float64())])
    return from_row(scored.where(F.col("score") >= least), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = learn(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0))
    return score(docs, machine).select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= KEEP_AT).cast("int").alias("predicted"))
