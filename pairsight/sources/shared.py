"""Intermediate relations that every executor can read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a table that tells what may be wanted, a power of two: 8 MB.
MOST_BITS = 1 << 26


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir and that all executors share; without one there is none to fall back to."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder that the session names in spark.checkpoint.dir and read from there, so that plans built on it stay small.

    Spark removes checkpoints that nothing refers to any more where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession) -> str:
    """A new folder beside the checkpoints for stored(). It goes when the application ends, or before by remove_folder()."""
    folder = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def stored(df: DataFrame, folder: str) -> DataFrame:
    """df, written to a folder of scratch() as compressed columns and read from there: for what grows with all quotations or lines, of which a checkpoint has uncompressed rows and is worked out twice."""
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Removes a folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def by_shuffle(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast. Spark takes any text for 20 bytes and doesn't count rows that are exploded, so what grows with the input may look small enough to go through the driver."""
    return df.hint("merge")


def may_be(hashes: DataFrame) -> Callable[[Column], Column]:
    """Whether a hash may be among hashes (h), by a table of bits, two for each: always for those that are, very seldom for others while there are few beside MOST_BITS. The table is a scalar of the plan, never a column of rows."""
    bits = min(MOST_BITS, max(1 << 12, 1 << (64 * hashes.count()).bit_length()))
    slots = lambda h: (h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1)))
    page = lambda slot: F.shiftright(slot, 6).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s").bitwiseAND(F.lit(63)).cast("int"))
    have = hashes.select(F.explode(F.array(*slots(F.col("h")))).alias("s")).select(page(F.col("s")).alias("i"), one.alias("b")).groupBy("i").agg(F.bit_or("b").alias("b"))
    every = hashes.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("i"), F.lit(0).cast("long").alias("b"))
    table = have.unionByName(every).groupBy("i").agg(F.bit_or("b").alias("b")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "b"))), lambda x: x["b"]).alias("table")).scalar()
    is_set = lambda slot: F.call_function("shiftright", F.get(table, page(slot)), slot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return lambda h: is_set(slots(h)[0]) & is_set(slots(h)[1])
