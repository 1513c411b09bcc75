"""Exact removal of long repeated word sequences, by recompression.

A window is WIDTH consecutive words of one document.  A word goes if a window that
covers it also starts in a document with a smaller doc_id.

1. Each text is recompressed (see recompression.py) in one pass; the names of the
   symbols chosen in its windows, one for about 15 words, are its anchors, with the
   words that fix them.
   Texts of equal words are one from here on: all but the smallest doc_id go whole.
2. An anchor in two different texts is shared.  Equal windows choose equal symbols,
   so only windows with a shared anchor can repeat.
3. Those windows are verified: their own fingerprints, of 128 bits, meet, and windows whose
   fingerprint has a smaller doc_id are repeats.

Counts and minima are partially aggregated before each shuffle, and no group is
collected but the windows of one document, so a passage in a third of all
documents is a large key of a join that Spark splits.

Defined results: a null text has no words; texts with fewer than WIDTH words lose
nothing; rows with the same doc_id never remove each other's words, and a row without one loses and
removes nothing; repeated rows are judged one by one; an empty table gives no rows; a very long text is handled alone;
other columns may have any names.  Texts are equal if the SHA-256 of their words is, windows if both
of their 64-bit fingerprints are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._words import sliced, windows, words_of
from ._work import among, as_row, batched, discarded, from_row, settled, table, with_row
from .recompression import anchors

WIDTH = 50


#: The seed of a window's second fingerprint.
SECOND = 0x6A09E667F3BCC909


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _sig(sha: str) -> int:
    """64 bits of it, as a signed number: they tell the texts of one doc_id apart."""
    return int(sha[:16], 16) - (1 << 63)


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_words, sha (of the words joined by spaces), sig and anchors of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in sliced(texts):
                w = words_of(texts[a:b])
                found = anchors(w.hash, w.first, width)
                own = [np.unique(found[i:j]) for i, j in zip(w.first[:-1], w.first[1:], strict=True)]
                own = [u[u > 0].view(np.int64) for u in own]
                sizes = np.concatenate(([0], np.cumsum([len(u) for u in own]))).astype(np.int32)
                sha = [_sha(_split(t)) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(np.diff(w.first).astype(np.int64)), pa.array([_sig(x) for x in sha], pa.int64()), pa.array(sha), pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([np.empty(0, np.int64), *own])))],
                    ["doc_id", "n_words", "sig", "sha", "anchors"],
                )

    return batched(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_words long, sig long, sha string, anchors array<long>")


def _matching(texts: DataFrame, width: int) -> DataFrame:
    """texts: doc_id, sig, shared (anchors), text. hash and second (fingerprints), doc_id, sig and start of each window with a shared anchor; rows whose words aren't sig's give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, sigs, shared = (batch.column(k) for k in (3, 0, 1, 2))
            texts = texts.to_pylist()
            for a, b in sliced(texts):
                w = words_of(texts[a:b])
                found = anchors(w.hash, w.first, width)
                for k in range(b - a):
                    if sigs[a + k].as_py() != _sig(_sha(_split(texts[a + k]))):
                        continue
                    part = found[w.first[k] : w.first[k + 1]].view(np.int64)
                    start = np.flatnonzero(np.isin(part, shared[a + k].values.to_numpy()))
                    if len(start):
                        own = w.hash[w.first[k] : w.first[k + 1]]
                        both = [pa.array(windows(own, width, seed)[start].view(np.int64)) for seed in (0, SECOND)]
                        yield pa.RecordBatch.from_arrays([*both, pa.array(np.full(len(start), ids[a + k].as_py())), pa.array(np.full(len(start), sigs[a + k].as_py())), pa.array(start.astype(np.int32))], ["hash", "second", "doc_id", "sig", "start"])

    return batched(texts.select("doc_id", "sig", "shared", "text"), run, "hash long, second long, doc_id long, sig long, start int")


def repeats(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profile of each row with copy_of, the doc_id of the smallest document with the same words; repeated windows: doc_id, sig, starts; texts that may hold them: doc_id, sig, text).

    Only rows that aren't copies of a smaller document have repeated windows here; copies go whole if they have width words.
    """
    profile = settled(profiles(docs, width), "profiles")
    # What is joined is written first: then both sides of a join are plain exchanges, and Spark can split a large key.
    first = settled(profile.where(F.col("n_words") >= width).groupBy("sha").agg(F.min("doc_id").alias("copy_of")), "first")
    rows = settled(profile.drop("anchors"), "rows").join(first, "sha", "left")
    shared = profile.select("sig", F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.min("sig").alias("a"), F.max("sig").alias("b")).where("a != b").select("anchor")
    shared = settled(shared, "anchors")
    own = profile.join(first, "sha").where("copy_of = doc_id").select("doc_id", "sig", F.explode("anchors").alias("anchor")).join(shared, "anchor")
    own = settled(own.groupBy("doc_id", "sig").agg(F.collect_set("anchor").alias("shared")), "shared")
    discarded(profile, shared)
    texts = settled(among(docs, own).join(own, "doc_id"), "texts")
    discarded(own)
    found = settled(_matching(texts, width), "windows")
    least = found.groupBy("hash", "second").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    least = settled(least, "least")
    starts = found.join(least, ["hash", "second"]).where("least < doc_id").groupBy("doc_id", "sig").agg(F.sort_array(F.collect_set("start")).alias("starts"))
    starts = settled(starts, "starts")
    discarded(found, least)
    return rows, starts, texts


def kept_words(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n words no window from starts covers."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + width, n), -1)
    return np.cumsum(delta)[:n] == 0


def digests(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row."""
    rows, starts, texts = repeats(docs, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, sig, text, at in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                words = _split(text)
                if sig != _sig(_sha(words)):
                    continue
                keep = kept_words(len(words), np.array(at, np.int64), width)
                out.append((doc_id, sig, int(len(words) - keep.sum()), _sha([w for w, k in zip(words, keep.tolist(), strict=True) if k])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["doc_id", "sig", "removed", "kept"])

    part = batched(texts.join(starts, ["doc_id", "sig"]).select("doc_id", "sig", "text", "starts"), run, "doc_id long, sig long, removed long, kept string").dropDuplicates(["doc_id", "sig"])
    copy = F.coalesce((F.col("n_words") >= width) & (F.col("copy_of") < F.col("doc_id")), F.lit(False))
    return rows.join(part, ["doc_id", "sig"], "left").select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def deduplicated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs (doc_id, text and other columns) without the repeated words; n_chars, if there, follows; a text that loses all its words goes with its row."""
    rows, starts, texts = repeats(docs, width)
    discarded(texts)
    copies = rows.where((F.col("n_words") >= width) & (F.col("copy_of") < F.col("doc_id"))).select("doc_id", "sig", F.lit(None).cast("array<int>").alias("starts")).distinct()
    decisions = copies.unionByName(starts).groupBy("doc_id").agg(F.collect_list(F.struct("sig", "starts")).alias("found"))
    packed = docs.select(as_row(docs), F.col("doc_id").cast("long").alias("doc_id")).join(decisions, "doc_id", "left").select("row", F.col("row").getField("text").alias("text"), "found")
    schema = with_row(packed, "text string, found boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_cut(text, found, width) if found else text for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array([f is not None for f in batch.column(2).to_pylist()])], schema.names)

    changed = batched(packed, run, schema).where("not found or text != ''")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("found"), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return from_row(changed, docs.columns, **new)


def _cut(text: str | None, found: list[dict], width: int) -> str | None:
    """The text without its repeated words. found: sig and starts (null: all words go) for the texts of its doc_id."""
    sig = _sig(_sha(_split(text)))
    match = [f["starts"] for f in found if f["sig"] == sig]
    if not match or match[0] is None:
        return "" if match else text
    w = words_of([text])
    keep = kept_words(len(w.start), np.array(match[0], np.int64), width)
    # Runs of kept words stay as they stand, with the white space between them.
    edge = np.diff(np.concatenate(([False], keep, [False])).astype(np.int8))
    data = w.data.tobytes()
    return "\n".join(data[w.start[a] : w.end[b - 1]].decode("utf-8", "surrogatepass") for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
