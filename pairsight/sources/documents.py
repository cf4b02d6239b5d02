"""Documents as relations: texts, uploads and binary files with a reader of the caller's choice, and their lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import found_at

#: pair_id, doc_key (protocol or report), name and text; a form feed ends a page, a line feed a line.
DOCUMENTS = "pair_id string, doc_key string, name string, text string"
MOST_UPLOAD_BYTES = 25 << 20


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """DOCUMENTS from files named <pair_id>/<doc_key>.txt under a path."""
    read = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select("value", F.col("_metadata.file_path").alias("path"))
    part = lambda n: F.element_at(F.split("path", "/"), n)
    return read.select(part(-2).alias("pair_id"), F.regexp_replace(part(-1), r"\.txt$", "").alias("doc_key"), part(-1).alias("name"), F.col("value").alias("text"))


def binary_files(spark: SparkSession, path: str, reader: Callable[[bytes], str], glob: str = "*.pdf") -> DataFrame:
    """DOCUMENTS and file_sha256 from binary files; reader turns one file's bytes into text with page ends. Files are read and parsed by tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf.assign(text=[reader(bytes(b)) for b in pdf.pop("content")])

    part = lambda n: F.element_at(F.split("path", "/"), n)
    named = files.select(part(-2).alias("pair_id"), F.regexp_replace(part(-1), r"\.\w+$", "").alias("doc_key"), part(-1).alias("name"), F.sha2("content", 256).alias("file_sha256"), "content")
    return named.mapInPandas(parse, "pair_id string, doc_key string, name string, file_sha256 string, text string")


def uploads(df: DataFrame, data: str = "data", name: str = "name") -> DataFrame:
    """df with ``content``, the bytes of a base64 column, and ``error`` where they can't be taken: not base64, empty, too large or no PDF."""
    content = F.try_to_binary(F.col(data), F.lit("base64"))
    size = F.octet_length(content)
    error = F.when(content.isNull(), "not base64").when(size == 0, "empty").when(size > MOST_UPLOAD_BYTES, "too large").when(F.substring(content, 1, 4) != F.lit(b"%PDF"), "not a PDF")
    return df.withColumn("error", error).withColumn("content", F.when(error.isNull(), content)).withColumn(name, base_name(F.col(name)))


def lines(documents: DataFrame) -> DataFrame:
    """pair_id, doc_key, page, line, raw: every line, pages and lines counted from 1."""
    pages = documents.select("pair_id", "doc_key", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\f")).alias("page", "body"))
    return pages.select("pair_id", "doc_key", (F.col("page") + 1).alias("page"), F.posexplode(F.split("body", "\n")).alias("line", "raw")).select("pair_id", "doc_key", "page", (F.col("line") + 1).alias("line"), "raw")


def with_hash(documents: DataFrame) -> DataFrame:
    return documents.withColumn("text_sha256", F.sha2(F.replace("text", F.lit("\f"), F.lit("\n")).cast("binary"), 256))


def first_hits(all_lines: DataFrame, pattern: str, per: list[str] | None = None) -> DataFrame:
    """The first line of each document that a pattern is found in, with the place and text of the match."""
    keys = per or ["pair_id", "doc_key"]
    hits = all_lines.where(F.col("raw").rlike(pattern))
    first = hits.groupBy(*keys).agg(F.min(F.struct("page", "line", "raw")).alias("h")).select(*keys, "h.*")
    at = found_at("raw", F.lit(pattern))
    text = F.regexp_substr("raw", F.lit(pattern))
    return first.select(*keys, "page", "line", "raw", at.alias("start"), (at + F.length(text)).alias("end"), text.alias("match"))


def hits(all_lines: DataFrame, pattern: str) -> DataFrame:
    """Every line that a pattern is found in, with the place and text of its first match there."""
    at, text = found_at("raw", F.lit(pattern)), F.regexp_substr("raw", F.lit(pattern))
    return all_lines.where(F.col("raw").rlike(pattern)).select("*", at.alias("start"), (at + F.length(text)).alias("end"), text.alias("match"))


#: Fixed value: what the id of a run looks like.
RUN_ID = "^[0-9a-f]{12}$"


def base_name(name: Column) -> Column:
    """The last part of a path, whichever slashes it has, so that an uploaded name leads nowhere else."""
    return F.element_at(F.split(name, r"[/\\]"), -1)


def is_run_id(text: Column) -> Column:
    return F.coalesce(text.rlike(RUN_ID), F.lit(False))


def contains(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(f"(?iU){pattern}"), F.lit(False))
