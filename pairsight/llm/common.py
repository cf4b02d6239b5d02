"""Small helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A non-ASCII character that Unicode lower-casing could change.
NON_ASCII_UPPER = r"[\p{javaUpperCase}\p{javaTitleCase}&&[^\x00-\x7F]]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir and that all executors share; without one there is none to fall back to."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Removes what was written to the shared folder and isn't read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows that tasks hand to Python at a time at most.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Texts may be long, so that the usual 10,000 rows at a time would fill an executor: lowers the session's spark.sql.execution.arrow.maxRecordsPerBatch to BATCH_ROWS where it is higher or unbounded."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only. Built-in lower() does that wherever no other character has a case to lose."""
    return F.when(text.rlike(NON_ASCII_UPPER), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def held_out(doc_id: Column) -> Column:
    """True for the fold from which no label may be learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns, each computed once a row: they are generated, so later filters and functions read them instead of holding their expressions again."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def row_key(text: Column) -> Column:
    """128 bits by which texts are told apart, the same each time that a row is computed. Null and empty texts are the same."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit(1)).alias("b"))
