"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked (a class).  A class is dealt to the shards by
a hash of its rows; what lies in one shard is a unit.  In each round a unit wants
to move to the shard that holds most of its class (its neighbours), among shards
with free capacity, and moves are granted in order of class size while the
target's quota lasts.  Linked rows get at most floor(rows / shards) places of a
shard, so the law ``rows`` holds at the end: documents without a link fill
the shards, and of a shard's rows those beyond its share (unlinked ones last) go
to the shards below theirs; sizes then differ by one row at most.

A class with a third of all rows is at most ``shards`` units, and its rows are
never collected; ranks are taken in hashed buckets of about BUCKET_ROWS rows.

Defined results: a null text counts as an empty one in size and class; repeated
rows are placed one by one; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._work import settled, table

SHARDS, ROUNDS = 16, 3
BUCKET_ROWS = 20_000
_CLASS = ("class_a", "class_b", "size")


def _looked_up(values: list[int], index: Column) -> Column:
    """values[index]: a list with one entry a shard."""
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), index.cast("int") + 1)


def _per_shard(df: DataFrame, amount: Column, shards: int) -> list[int]:
    out = [0] * shards
    for shard, n in df.groupBy("shard").agg(F.sum(amount)).collect():
        out[shard] = int(n)
    return out


def propagate(units: DataFrame, shards: int, places: int, rounds: int = ROUNDS, salts: int = 1) -> DataFrame:
    """units (class columns, origin, n_rows, class_rows, shard) with the shards after the last round."""
    group = list(_CLASS)
    for _ in range(rounds):
        free = [places - load for load in _per_shard(units, F.col("n_rows"), shards)]
        there = units.withColumn("here", F.sum("n_rows").over(Window.partitionBy(*group, "shard")))
        choice = F.when(_looked_up(free, F.col("shard")) > 0, F.struct("here", F.xxhash64(*group, "shard").alias("tie"), "shard"))
        wished = there.withColumn("target", F.max(choice).over(Window.partitionBy(*group))["shard"])
        moves = F.col("target").isNotNull() & (F.col("target") != F.col("shard"))
        wished = wished.withColumn("asked", F.when(moves, F.col("n_rows")).otherwise(0)).withColumn("salt", F.pmod(F.xxhash64(*group), F.lit(salts)))
        queue = Window.partitionBy("target", "salt").orderBy((F.col("asked") == 0), "class_rows", *group, "origin").rowsBetween(Window.unboundedPreceding, 0)
        granted = moves & (F.sum("asked").over(queue) * salts <= _looked_up(free, F.coalesce("target", F.lit(0))))
        units = settled(wished.withColumn("shard", F.when(granted, F.col("target")).otherwise(F.col("shard"))).select(*group, "origin", "n_rows", "class_rows", "shard"), "units")
    return units


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and class_rows of each row of docs (doc_id, text)."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("class_a"), F.xxhash64(F.lit(shards + 1), text).alias("class_b"), F.monotonically_increasing_id().alias("row"),
    )
    rows = settled(rows.withColumn("origin", F.pmod(F.xxhash64("row", F.lit(5)), F.lit(shards)).cast("int")), "rows")
    total = rows.count()
    group = list(_CLASS)
    units = rows.groupBy(*group, "origin").agg(F.count("*").alias("n_rows")).withColumn("class_rows", F.sum("n_rows").over(Window.partitionBy(*group)))
    units = settled(units.where("class_rows > 1").withColumn("shard", F.col("origin")), "units")
    units = propagate(units, shards, total // shards, rounds, 1 + total // (shards * BUCKET_ROWS * 8))

    placed = rows.join(units.select(*group, "origin", "class_rows", "shard"), [*group, "origin"], "left")
    buckets = max(4, -(-total // (shards * BUCKET_ROWS)))
    placed = placed.select(
        "doc_id", "size", "text_crc32", "row", F.coalesce("shard", "origin").alias("shard"), F.coalesce("class_rows", F.lit(1)).alias("class_rows"), F.col("shard").isNull().alias("single"),
        F.pmod(F.xxhash64("row", F.lit(9)), F.lit(buckets)).alias("bucket"),
    )
    placed = settled(placed, "placed")
    cells = placed.groupBy("shard", "single", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("single", "bucket").rowsBetween(Window.unboundedPreceding, -1))
    cells = settled(cells.withColumn("before", F.coalesce(before, F.lit(0))), "cells")
    load = _per_shard(cells, F.col("n"), shards)
    share = [total // shards + (k < total % shards) for k in range(shards)]
    over, under = [max(0, a - b) for a, b in zip(load, share, strict=True)], [max(0, b - a) for a, b in zip(load, share, strict=True)]
    over_before, under_before = [sum(over[:k]) for k in range(shards)], [sum(under[:k]) for k in range(shards)]

    ranked = placed.join(cells.select("shard", "single", "bucket", "before"), ["shard", "single", "bucket"])
    inside = F.row_number().over(Window.partitionBy("shard", "single", "bucket").orderBy("doc_id", "row"))
    ranked = ranked.withColumn("rank", F.col("before") + inside - 1)
    surplus = F.when(F.col("rank") >= _looked_up(share, F.col("shard")), F.col("rank") - _looked_up(share, F.col("shard")) + _looked_up(over_before, F.col("shard")))
    ranked = ranked.withColumn("surplus", surplus)
    target: Column = F.lit(None).cast("int")
    for k in range(shards):
        if under[k]:
            target = F.when((F.col("surplus") >= under_before[k]) & (F.col("surplus") < under_before[k] + under[k]), F.lit(k)).otherwise(target)
    ranked = ranked.withColumn("target", target)
    slot = F.when(F.col("target").isNull(), F.col("rank")).otherwise(F.col("surplus") - _looked_up(under_before, F.coalesce("target", F.lit(0))) + _looked_up(load, F.coalesce("target", F.lit(0))))
    return ranked.select("doc_id", "size", "text_crc32", F.coalesce("target", "shard").cast("int").alias("shard"), slot.cast("long").alias("slot"), "class_rows")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
