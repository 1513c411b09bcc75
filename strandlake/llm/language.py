"""Language identification by compression.

Each language gets a zstandard raw-content dictionary made of sample text.  A
text's letters are cut into blocks of BLOCK_BYTES (all of them; the cut keeps the
dictionary near every part), each block is compressed with each dictionary, in one setting for all, and the
language whose total is smallest wins.  A narrow margin is a rejection.

Defined results: null text, or text without any letter, is ``und`` with score 0;
without a learned language (an empty table, too) everything is ``und``; ties go to the language that
sorts first; repeated rows are judged one by one; of a very long text each block is compressed.  Extra columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._work import batched, crc_mod, table

#: Bounds of the training sample: texts a language, and bytes of letters of each, from a hashed offset on.
SAMPLE_TEXTS, SAMPLE_BYTES = 96, 1200
#: All languages are learned; beyond so many, pieces shrink so that the dictionaries' total stays, down to LEAST_BYTES of a text.
FULL_LANGUAGES, LEAST_BYTES = 64, 48
BLOCK_BYTES = 2048
#: zstandard's level and shortest match.
LEVEL, LEAST_MATCH = 12, 3
#: Share by which the second smallest total must exceed the smallest, else the text is rejected.
MARGIN = 0.01

_LETTER = re.compile(r"[^\W\d_]")
_REST = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """The text's letters in lower case, all else between them one space."""
    return _REST.sub(" ", text.lower())


def learn(docs: DataFrame) -> dict[str, bytes]:
    """Dictionaries of all languages from the rows of docs with a lang: SAMPLE_TEXTS of each, chosen by a hash of doc_id, and of each text a piece at a hashed offset."""
    rows = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    languages = rows.agg(F.count_distinct("lang")).first()[0]
    size = max(LEAST_BYTES, int(SAMPLE_BYTES * min(1.0, FULL_LANGUAGES / max(1, languages))))
    # Of a text that is longer the piece may begin wherever so many characters are left.
    places = F.greatest(F.char_length("text") - size + 1, F.lit(1))
    piece = F.substring("text", F.pmod(F.xxhash64("doc_id", F.lit("piece")), places).cast("int") + 1, F.lit(size))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    sample = rows.withColumn("text", piece).withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLE_TEXTS)
    parts: dict[str, list[bytes]] = {}
    for lang, _, text in sorted(sample.select("lang", "k", "text").collect()):
        parts.setdefault(lang, []).append(letters(text).encode("utf-8", "surrogatepass")[:size])
    return {lang: b"\n".join(texts) for lang, texts in sorted(parts.items()) if any(texts)}


class Compressors:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.languages = sorted(dictionaries)
        self.each = [self._compressor(dictionaries[x]) for x in self.languages]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=BLOCK_BYTES, dict_size=len(content), min_match=LEAST_MATCH, write_checksum=False, write_content_size=False)
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=settings)
        return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings)

    def sizes(self, text: str) -> list[int]:
        data = letters(text).encode("utf-8", "surrogatepass")
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.each]

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """(language, score from 0 to 1, margin)."""
        if not self.languages or text is None or not _LETTER.search(text):
            return "und", 0.0, 0.0
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = [s for i, s in enumerate(sizes) if i != best]
        score = 1 / (1 + sum(math.exp(-min(700.0, (s - sizes[best]) / 4)) for s in rest))
        return self.languages[best], score, (min(rest) - sizes[best]) / sizes[best] if rest else 1.0


def classify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, margin and rejected (margin too narrow, or und) of each row. learn() bounds the dictionaries' total size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Compressors(dictionaries)
        for batch in batches:
            found = [model.classify(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64()), pa.array([f[0] == "und" or f[2] < margin for f in found], pa.bool_())],
                ["doc_id", "lang_pred", "score", "margin", "rejected"],
            )

    return batched(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, lang_pred string, score double, margin double, rejected boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = classify(docs, learn(docs.where(crc_mod(F.col("doc_id"), 3) != 1)))
    return found.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", "rejected")
