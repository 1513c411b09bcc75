"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.  All but the last return the
columns of ``documents``:

1. ``quality``: a factorisation machine, fitted on the labelled documents, drops what it rejects.
2. ``near_duplicates``: of documents linked by five-word shingles with a similarity of 0.8 or
   more, the one with the smallest doc_id stays.
3. ``repeated_passages``: words of 50-word windows that a document with a smaller doc_id
   holds too are cut out; a document left without words goes.
4. ``decontamination``: documents that overlap a benchmark item go.
5. ``packing``: the rest is packed into sequences of at most 1024 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import decontamination, ngrams, packing, quality, substrings
from strandlake.llm._work import discarded, settled, table

NEAR = ngrams.Rule(width=5, share=80, scale=100)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngrams.representatives(docs, NEAR)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(docs)


def untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", good), ("near_duplicates", distinct), ("repeated_passages", unrepeated), ("decontamination", untested), ("packing", packed)]

#: SQL can't express the classifier, the tokenizer and the dynamic programme.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
        if last is not None:
            discarded(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
