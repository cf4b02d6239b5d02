"""The corpus pipeline: documents that are fit to train on, as token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the
columns of documents. Rows with a null text count as empty texts and stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsight.llm.common import remove_folder, shared_folder, table
from pairsight.llm.decontaminate import decontaminate
from pairsight.llm.pieces import encode, load_vocabulary
from pairsight.llm.secrets import redact_secrets
from pairsight.llm.simhash import near_duplicates
from pairsight.llm.toxicity import score_toxicity, train_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score for toxicity stays below TOXIC. The model learns from the labelled documents that came in."""
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs.select(COLUMNS), model, name="_score").where(F.col("_score") < TOXIC).select(COLUMNS)


def text_key() -> Column:
    """What tells texts apart whatever their ids; null and empty texts are the same."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id, null ids last, and of equal ids one text; of rows that repeat both, one."""
    docs = docs.select(COLUMNS)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), text_key().alias("text"))
    first = near_duplicates(docs.select(row.alias("doc_id"), "text")).where(F.col("doc_id") == F.col("component_id"))
    first = first.select(F.col("doc_id.id").alias("_first"), F.col("doc_id.text").alias("_first_text")).distinct()
    docs = docs.withColumn("_text_key", text_key())
    kept = docs.join(first, docs["doc_id"].eqNullSafe(first["_first"]) & (docs["_text_key"] == first["_first_text"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "_text_key"]).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate. A text decides, whatever ids its rows have."""
    docs = docs.select(COLUMNS).withColumn("_text_key", text_key())
    found = decontaminate(docs.select("_text_key", "text"), table(spark, sf_dir, "benchmark"), doc_id="_text_key").where("contaminated").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(found, docs["_text_key"] == found["_gone"], "left_anti").select(COLUMNS)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by its kind in brackets."""
    return redact_secrets(docs.select(COLUMNS)).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of every document."""
    coded = encode(docs.select(COLUMNS), load_vocabulary(), keep=["doc_id", "source"])
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", hide_secrets),
    ("tokens", tokenize),
]

#: SQL can express neither the learnt scores nor the lattice; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage returns is written to the shared folder and read again by the next."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove_folder(spark, before)
        before = f"{folder}/{name}"
    return docs
