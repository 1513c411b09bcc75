"""A rank directory that grows with a stream of appended blocks.

Each micro-batch brings whole blocks (seq_id, blk, content). Its counts are appended to a Parquet folder by
batch number, so a batch that runs twice replaces itself: the sink is idempotent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


SCHEMA = "seq_id long, blk long, content string"


def counts(blocks: DataFrame) -> DataFrame:
    chars = blocks.select("seq_id", "blk", F.explode(F.split("content", "")).alias("sym")).where("sym != ''")
    return chars.groupBy("seq_id", "blk", "sym").agg(F.count("*").alias("cnt"))


def start(blocks: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Maintain the counts under folder from a stream of SCHEMA; all that is there is processed, then the query ends."""

    def write(batch: DataFrame, number: int) -> None:
        counts(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return blocks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def directory(spark: SparkSession, folder: str) -> DataFrame:
    """The directory (seq_id, blk, sym, cnt, prefix_cnt) of all batches so far."""
    from pyspark.sql import Window

    found = spark.read.schema("seq_id long, blk long, sym string, cnt long").parquet(f"{folder}/batch=*")
    before = F.sum("cnt").over(Window.partitionBy("seq_id", "sym").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("prefix_cnt", F.coalesce(before, F.lit(0)))


__all__ = ["SCHEMA", "counts", "directory", "start"]
