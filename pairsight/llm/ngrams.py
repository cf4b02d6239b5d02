"""Hashed word n-grams as flat numpy arrays: Spark splits and hashes, tasks index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows, of two integers each, that are broadcast at most; more are joined by shuffling.
BROADCAST_LABELS = 4_000_000


def hashed(text: Column, pattern: str, lower: bool = True) -> Column:
    """The 64-bit hashes of all matches in a text, in order. Null has none."""
    text = F.coalesce(text, F.lit(""))
    return F.transform(F.regexp_extract_all(F.lower(text) if lower else text, F.lit(pattern), F.lit(0)), lambda w: F.xxhash64(w))


def flat(arrays: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a batch end to end, and how many each row has."""
    sizes = np.fromiter((len(a) for a in arrays), np.int64, len(arrays))
    return (np.concatenate(arrays.to_list()) if sizes.sum() else np.zeros(0, np.int64)).astype(np.int64), sizes


def row_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given sizes, empty ones included. A run's sum doesn't depend on other runs."""
    out = np.zeros(len(sizes))
    if len(values):
        out[sizes > 0] = np.add.reduceat(values.astype(np.float64), (np.cumsum(sizes) - sizes)[sizes > 0])
    return out


def with_labels(docs: DataFrame, labels: DataFrame, label: str, keep: Column) -> DataFrame:
    """Rows of docs that have a label and satisfy ``keep``, a condition on doc_id; an id that repeats in labels counts once, with its largest label."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(keep & F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    return docs.join(F.broadcast(known) if labels.count() <= BROADCAST_LABELS else known, "doc_id")
