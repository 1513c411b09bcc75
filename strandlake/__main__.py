"""Build the block tree of a text file, report its size and check its answers: ``python -m strandlake FILE``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import bits, build, metrics, tree
from .sources import store, tables
from .types import TreeConfig


def parser() -> argparse.ArgumentParser:
    found = argparse.ArgumentParser(prog="strandlake", description=__doc__)
    found.add_argument("file")
    found.add_argument("--arity", type=int, default=4)
    found.add_argument("--leaf", type=int, default=8, help="symbols of a leaf at most")
    found.add_argument("--sources", choices=("windows", "lpf"), default="windows")
    found.add_argument("--threads", type=int, default=None, help="shuffle partitions")
    found.add_argument("--bits", action="store_true", help="take the file's bytes as bits, lowest first")
    found.add_argument("--output", help="folder to save the tree in")
    found.add_argument("--verify", action="store_true", help="decode the tree, ask it for each symbol, and compare")
    return found


def run(spark: SparkSession, options: argparse.Namespace) -> dict:
    if options.threads:
        spark.conf.set("spark.sql.shuffle.partitions", options.threads)
    rows = spark.read.format("binaryFile").load(options.file).select(F.lit(0).cast("long").alias("seq_id"), "content")
    if rows.isEmpty():
        raise FileNotFoundError(options.file)
    if options.bits:
        sequences = bits.byte_texts(tables.bits_from_bytes(rows, "seq_id", "content"))
    else:
        sequences = rows.select("seq_id", F.decode("content", "UTF-8").alias("text"))
    config = TreeConfig(arity=options.arity, max_leaf=options.leaf, sources=options.sources)
    out = {"file": options.file, **metrics.build_report(spark, sequences.select("seq_id", "text"), config).first().asDict()}
    blocks, leaves = build.build(sequences.select("seq_id", "text"), config)
    if options.output:
        store.save_tree(blocks, leaves, config.arity, options.output)
    if options.verify:
        spelled = tree.verify(sequences, blocks, leaves, config.arity).where("not ok").count()
        answers = tree.verify_answers(sequences, blocks, leaves, config.arity).agg(F.sum("checked"), F.sum(F.col("wrong_access") + F.col("wrong_rank") + F.col("wrong_select"))).first()
        out |= {"checked": answers[0] or 0, "verified": not spelled and not answers[1]}
    return out


def main(arguments: list[str] | None = None) -> None:
    options = parser().parse_args(arguments)
    print(json.dumps(run(SparkSession.builder.appName("strandlake").getOrCreate(), options)))


if __name__ == "__main__":
    main()
