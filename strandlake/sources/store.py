"""Trees and directories kept as tables: build once, query often."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset and all tasks run in this process, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="strandlake-")
    return folder.rstrip("/")


def save_tree(blocks: DataFrame, leaves: DataFrame, arity: int, folder: str) -> None:
    """Write a built tree to a new folder: its blocks by level, its leaves with the arity."""
    blocks.drop("content").write.partitionBy("level").parquet(f"{folder}/blocks")
    leaves.withColumn("arity", F.lit(arity)).write.parquet(f"{folder}/leaves")


def load_tree(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, int, int]:
    """(blocks, leaves, arity, levels) of a saved tree; a level's blocks are one partition, so a descent reads each level alone."""
    blocks, leaves = spark.read.parquet(f"{folder}/blocks"), spark.read.parquet(f"{folder}/leaves")
    first, top = leaves.select("arity").first(), blocks.agg(F.max("level")).first()[0]
    return blocks, leaves.drop("arity"), first[0] if first else 1, (top if top is not None else -1) + 1


def save_forest(packed: DataFrame, arity: int, folder: str) -> None:
    """Write packed trees (forest.py), a row each, to a new folder."""
    packed.withColumn("arity", F.lit(arity)).write.parquet(folder)


def load_forest(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """(packed trees, arity)."""
    found = spark.read.parquet(folder)
    first = found.select("arity").first()
    return found.drop("arity"), first[0] if first else 1


def save_directory(directory: DataFrame, block: int, folder: str) -> None:
    directory.withColumn("block", F.lit(block)).write.parquet(folder)


def load_directory(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """(directory, symbols of a block)."""
    found = spark.read.parquet(folder)
    first = found.select("block").first()
    return found.drop("block"), first[0] if first else 1
