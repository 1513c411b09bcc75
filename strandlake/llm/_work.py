"""Tables that cut lineage, kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def work_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset and all tasks run in this process (tests), a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = getattr(spark.sparkContext, "_strandlake_folder", None)
        if not folder:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = spark.sparkContext._strandlake_folder = tempfile.mkdtemp(prefix="strandlake-")
    return folder.rstrip("/")


#: Rows of an Arrow batch at most: executors hold a few batches for each task outside the heap.
BATCH_ROWS = 1000


def batched(df: DataFrame, run, schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow(run, schema), in batches of at most BATCH_ROWS rows (a setting of the session from then on)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)
    return df.mapInArrow(run, schema)


def settled(df: DataFrame, label: str = "table") -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there, and lost executors cost no rerun."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discarded(*tables: DataFrame) -> None:
    """Deletes the files of tables that settled() gave. Only for what nothing reads any more: whatever was made from them has itself been written."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._settled_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of the value written as text, modulo modulus."""
    return F.pmod(F.crc32(F.encode(column.cast("string"), "UTF-8")), F.lit(modulus))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def as_row(df: DataFrame) -> Column:
    """df's rows as one struct column ``row``, which keeps their columns apart from others, whatever their names."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row")


def from_row(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns that as_row() has packed; new: those that change."""
    return df.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in columns])


def with_row(packed: DataFrame, added: str) -> T.StructType:
    """The schema of packed's struct ``row`` and of more columns."""
    return T.StructType([packed.schema["row"], *T.StructType.fromDDL(added).fields])


def with_added(df: DataFrame, text: str, added: str, make) -> DataFrame:
    """df's rows as a struct column ``row``, and columns made from their texts: added is their schema, make gives their pyarrow arrays from a list of texts."""
    import pyarrow as pa

    from ._words import sliced

    packed = df.select(as_row(df), F.col(quoted(text)).alias("text"))
    schema = with_row(packed, added)
    names = schema.names

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in sliced(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *make(texts[a:b])], names)

    return batched(packed, run, schema)


class Filter:
    """A bitmap of 64-bit hashes that tells which rows may be in a table. It has about eight bits a row, within LEAST_BITS and MOST_BITS: beyond that it
    lets more pass, which whoever joins the rest with the table drops."""

    LEAST_BITS, MOST_BITS = 16, 29

    def __init__(self, hashes: DataFrame, key: str):
        """hashes: a table whose column ``key`` is to be known. What reaches the driver is bounded by the bitmap."""
        import numpy as np

        rows = hashes.where(F.col(key).isNotNull()).select(F.col(key).alias("key"))
        self.bits = min(self.MOST_BITS, max(self.LEAST_BITS, (8 * rows.count()).bit_length()))
        place = F.shiftrightunsigned("key", 64 - self.bits)
        words = rows.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - self.bits}) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
        out = np.zeros(1 << (self.bits - 6), np.int64)
        found = words.toArrow()
        out[found.column(0).to_numpy()] = found.column(1).to_numpy()
        self.held = out.view(np.uint8)

    def keep(self, batch, column: int):
        """The rows of a record batch whose column, a hash, may be in the table."""
        import numpy as np
        import pyarrow as pa

        k = batch.column(column).to_numpy().view(np.uint64) >> np.uint64(64 - self.bits)
        return batch.filter(pa.array((self.held[(k >> np.uint64(3)).astype(np.int64)] >> (k & np.uint64(7)).astype(np.uint8)) & 1 == 1))


def among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the rows of docs whose doc_id is in ids (a table), and maybe of a few others: a join with ids moves little else, however large docs is."""
    held = Filter(ids.select(F.xxhash64("doc_id").alias("key")), "key")

    def run(batches):
        for batch in batches:
            yield held.keep(batch, 2).select([0, 1])

    return batched(docs.select(F.col("doc_id").cast("long"), "text").withColumn("key", F.xxhash64("doc_id")), run, "doc_id long, text string")
