"""Reviews again only of what has changed since the records at hand were made."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..sources.outputs import payload
from ..sources.pairfiles import RECORD_NAME, document_files
from ..sources.shared import settle
from .review import Review, review


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """pair_id and payload of the records under ``<path>/<pair_id>/``; none where there is no such folder or a record can't be read."""
    return document_files(spark, path, glob=RECORD_NAME, missing="none").where("error IS NULL").select("pair_id", F.col("text").alias("payload"))


def hashes(documents: DataFrame) -> DataFrame:
    """pair_id and state, a hash of all that a review of the pair depends on: its documents' keys, names and texts, and the version. Null texts are texts of their own."""
    each = F.struct(F.col("doc_key"), F.col("name"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    return _state(documents.select("pair_id", each.alias("d")), F.lit(__version__))


def _state(rows: DataFrame, version) -> DataFrame:
    said = F.to_json(F.array_sort(F.collect_list("d")), {"ignoreNullFields": "false"})
    return rows.withColumn("version", version).groupBy("pair_id").agg(F.sha2(F.concat_ws("\n", F.max("version"), said), 256).alias("state"))


def recorded(payloads: DataFrame) -> DataFrame:
    """pair_id and state as the manifests of records have them."""
    kind = "manifest struct<version:string,documents:array<struct<doc_key:string,name:string,text_sha256:string>>>"
    m = payloads.select("pair_id", F.from_json("payload", kind)["manifest"].alias("m"))
    return _state(m.select("pair_id", "m.version", F.explode("m.documents").alias("d")), F.col("version"))


def changes(documents: DataFrame, payloads: DataFrame) -> DataFrame:
    """pair_id and change (new, changed or gone) of pairs whose documents aren't those of their record. Only hashes are compared; pairs without a record, as those with a parse error have none, are new."""
    now, then = hashes(documents).withColumnRenamed("state", "now"), recorded(payloads).withColumnRenamed("state", "then")
    change = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("now") != F.col("then"), "changed")
    return now.join(then, "pair_id", "full").select("pair_id", change.alias("change")).where("change IS NOT NULL")


def review_changes(documents: DataFrame, payloads: DataFrame, **options) -> tuple[Review, DataFrame, DataFrame]:
    """The review of new and changed pairs, the records of all pairs as a full review would give them, and changes(). options: review()'s."""
    changed = settle(changes(documents, payloads))
    result = review(documents.join(changed.where("change <> 'gone'"), "pair_id", "left_semi"), **options)
    return result, payloads.join(changed, "pair_id", "left_anti").unionByName(payload(result)), changed
