"""Quality classifier: logistic regression on hashed word n-grams, learnt by follow-the-regularised-leader.

Words, and runs of other characters between white space, are tokens; a text's features are its tokens and token
pairs, hashed to ``1 << BITS`` places, each with its share of the text as value. A bounded, even sample of the
labelled rows is dealt to SHARDS learners by a hash of the id; each runs proximal updates over its rows, and the
means of their weights make the model. Scoring is a sparse dot product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held_out
from .ngrams import flat, hashed, row_sums, with_labels

TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+"
BITS = 18
#: Labelled rows that are learnt from, about; all of them where there are fewer.
SAMPLE_ROWS = 24_000
SHARDS, EPOCHS = 8, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
#: A feature's value is its share of the text times this.
SCALE = 20.0
_FEATURES = 2


def _places(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all tokens and of all pairs; a row's first token makes a pair with its start, and a token that comes again, at once or after another, makes the same pair whatever it is."""
    mask = np.uint64((1 << BITS) - 1)
    h = hashes.astype(np.uint64)
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    before = np.roll(h, 1)
    before[first] = 0
    two_before = np.roll(before, 1)
    two_before[first] = 0
    pair = before * np.uint64(0x9E3779B97F4A7C15) ^ h
    pair[two_before == h] = 2
    pair[before == h] = 1
    pair = (pair ^ (pair >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h & mask).astype(np.int64), ((pair >> np.uint64(32)) & mask).astype(np.int64)


def _dot(weights: np.ndarray, bias: float, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    one, two = _places(hashes, sizes)
    z = bias + SCALE * row_sums(weights[one] + weights[two], sizes) / np.maximum(_FEATURES * sizes, 1)
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _learn(words: pd.Series, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Proximal updates with a rate of its own for each weight; the bias is the last place and isn't regularised."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    rows = []
    for h in words:
        places, counts = np.unique(np.concatenate(_places(*flat(pd.Series([h])))), return_counts=True)
        rows.append((np.append(places, size), np.append(SCALE * counts / max(counts.sum(), 1), 1.0)))

    def weight(i: np.ndarray) -> np.ndarray:
        l1 = np.where(i == size, 0.0, L1)
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for (i, x), y in zip(rows, labels, strict=True):
            w = weight(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    w = weight(np.arange(size + 1))
    return w[:-1], float(w[-1])


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[np.ndarray, float]:
    """Weights and bias, learnt from rows of labels that aren't held out. docs: doc_id and text. Without such rows every score is 0.5."""
    learnt = ~held_out(F.col("doc_id"))
    total = labels.where(learnt & F.col(label).isNotNull()).count()
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("quality")), F.lit(1 << 20))
    rows = with_labels(docs.select("doc_id", "text"), labels, label, learnt & (place < (1 << 20) * SAMPLE_ROWS // max(total, SAMPLE_ROWS)))
    rows = rows.select(F.pmod(place, F.lit(SHARDS)).cast("int").alias("shard"), place.alias("place"), "doc_id", "label", hashed(F.col("text"), TOKEN, lower=False).alias("w"))

    def learner(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", "doc_id"])
        w, bias = _learn(pdf["w"], pdf["label"].to_numpy(np.float64))
        i = np.flatnonzero(w)
        return pd.DataFrame({"i": np.append(i, -1), "w": np.append(w[i], bias)})

    parts = rows.groupBy("shard").applyInPandas(learner, "i long, w double")
    got = parts.groupBy("i").agg(F.sum("w").alias("w"), F.count("*").alias("n")).toArrow().to_pandas()  # a row for each place at most
    weights = np.zeros(1 << BITS, np.float64)
    shards = max(int(got.loc[got["i"] == -1, "n"].sum()), 1)
    known = got[got["i"] >= 0]
    weights[known["i"].to_numpy(np.int64)] = known["w"].to_numpy() / shards
    return weights, float(got.loc[got["i"] == -1, "w"].sum()) / shards


def score_quality(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", name: str = "score") -> DataFrame:
    """docs and a column with the probability of label 1, in place of a column of that name. A text without tokens, null or empty, gets that of the bias.

    A score depends on the text alone, which may have any length; rows that repeat get the same.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(words: pd.Series) -> pd.Series:
        parts = [words.iloc[i : i + 512] for i in range(0, len(words), 512)]
        return pd.Series(np.concatenate([_dot(*shared.value, *flat(p)) for p in parts]) if parts else np.zeros(0))

    return docs.withColumn(name, score(hashed(F.col(text), TOKEN, lower=False)))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, score, predicted. Scores depend on the text alone."""
    docs = docs.select("doc_id", "text")
    scored = score_quality(docs, train_quality(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
