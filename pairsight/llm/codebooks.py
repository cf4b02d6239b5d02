"""Vector code compression: a codebook for each part of the vectors, learnt from distinct parts and their weights.

Equal integer parts at a position are one row with a weight, so a round of Lloyd's algorithm goes over distinct parts
only, whose number grows far slower than the vectors' once there are many. Codes and errors are found once for each
distinct part and joined back to the vectors by position and part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .vectors import integers, long_sum, whole

DIMENSIONS, SCALE = 64, 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Weights are summed in two halves, so that a batch's sums fit in a long.
_HALF = 20


def nearest_entries(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each part's nearest entry, of equally near ones the first, and its squared distance."""
    d = np.square(parts[:, None, :] - entries[None, :, :]).sum(axis=2)
    code = d.argmin(axis=1)
    return code, d[np.arange(len(parts)), code]


def _coded(batch: pa.RecordBatch, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position, part, code and error of each distinct part of a batch."""
    width = books.shape[2]
    at = batch.column("part").to_numpy()
    values = batch.column("ints").flatten().to_numpy().astype(np.int64).reshape(-1, width)
    code, error = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    for p in np.unique(at):
        mine = np.flatnonzero(at == p)
        for some in np.array_split(mine, len(mine) // 4096 + 1):
            code[some], error[some] = nearest_entries(values[some], books[p])
    return at, values, code, error


def _sums(books: np.ndarray):
    """From distinct parts to part, code, place and total: weighted sums of components, and of weights at place -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((*books.shape[:2], books.shape[2] + 1), object)
        for batch in batches:
            at, values, code, _ = _coded(batch, books)
            weight = batch.column("weight").to_numpy()
            more = np.hstack([values, np.ones((len(values), 1), np.int64)])
            for some in np.array_split(np.arange(len(at)), len(at) // 8192 + 1):
                for shift, w in ((0, weight[some] & ((1 << _HALF) - 1)), (_HALF, weight[some] >> _HALF)):
                    if w.any():
                        add = np.zeros(total.shape, np.int64)
                        np.add.at(add, (at[some], code[some]), more[some] * w[:, None])
                        total += add.astype(object) << shift
        part, entry = np.nonzero(total[:, :, -1])
        width = total.shape[2]
        places = np.tile([*range(width - 1), -1], len(part))
        flat = [Decimal(int(x)) for x in total[part, entry].reshape(-1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, width), pa.int32()), pa.array(np.repeat(entry, width), pa.int32()), pa.array(places, pa.int32()), pa.array(flat, pa.decimal128(38, 0))], names=["part", "code", "place", "total"])

    return run


def _code(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, code, error = _coded(batch, books)
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("ints"), pa.array(code, pa.int32()), pa.array(error)], names=["part", "ints", "code", "error"])

    return run


def compress_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """A row for each vector that is kept (vec_id, label, code, error), and the codebooks as entries of integers by part.

    Dropped are null vectors, vectors with null or non-finite components, and vectors of other than ``dimensions``
    components, which can't be cut alike. Components become floor(scale * x). A codebook starts as its part of the
    ``entries`` kept vectors with the smallest ids, ascending, null ids last, of equal ids the smaller vector first; where
    fewer are kept there are fewer entries. Unused entries stay. Rows that repeat are vectors of their own. Other
    columns are ignored. code: an index in two hex digits for each part.
    """
    if dimensions % parts or not 1 <= entries <= 256:
        raise ValueError("dimensions must be a multiple of parts, and entries at most 256")
    width = dimensions // parts
    kept = df.where((F.size(vector) == dimensions) & whole(F.col(vector))).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), integers(F.col(vector), scale).alias("ints"))
    # numbered before it is written, so that a row has the same number whenever it is read
    kept = cut(kept.withColumn("row", F.monotonically_increasing_id()))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "ints").select("ints").limit(entries).collect()
    books = np.array([r["ints"] for r in first], np.int64).reshape(-1, parts, width).swapaxes(0, 1)
    cuts = F.array(*(F.slice("ints", p * width + 1, width) for p in range(parts)))
    cut_up = kept.select("row", "vec_id", "label", F.posexplode(cuts).alias("part", "ints"))
    if not first:
        return cut_up.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), books
    distinct = cut(cut_up.groupBy("part", "ints").agg(F.count("*").alias("weight")))
    for _ in range(rounds):
        found = distinct.mapInArrow(_sums(books), "part int, code int, place int, total decimal(38,0)").groupBy("part", "code", "place").agg(F.sum("total").alias("total")).collect()
        sums = {(r["part"], r["code"], r["place"]): int(r["total"]) for r in found}
        books = np.array([[[sums[p, e, j] // sums[p, e, -1] for j in range(width)] if (p, e, -1) in sums else list(books[p, e]) for e in range(books.shape[1])] for p in range(parts)], np.int64)
    coded = distinct.select("part", "ints").mapInArrow(_code(books), "part int, ints array<int>, code int, error long")
    each = cut_up.join(coded, ["part", "ints"])
    # eight codes to a long
    words = range((parts + 7) // 8)
    digits = lambda w: min(8, parts - 8 * w)
    code = lambda w: F.bit_or(F.when(F.floor(F.col("part") / 8) == w, F.call_function("shiftleft", F.col("code").cast("long"), (8 * (digits(w) - 1 - F.col("part") % 8)).cast("int"))).otherwise(F.lit(0).cast("long")))
    whole_rows = each.groupBy("row", "vec_id", "label").agg(F.sum("error").alias("error"), *(code(w).alias(f"w{w}") for w in words))
    text = F.lower(F.concat(*(F.lpad(F.hex(f"w{w}"), 2 * digits(w), "0") for w in words)))
    return whole_rows.select("vec_id", "label", text.alias("code"), "error"), books


def code_digest(df: DataFrame) -> DataFrame:
    """A row for each vector kept: vec_id, code, error, label_error (over rows of the same label, null a label of its own) and codebooks_sha256. Sums that a long can't hold are the largest long."""
    found, books = compress_vectors(df.select("vec_id", "embedding", "label"))
    found = cut(found)
    by_label = found.groupBy("label").agg(long_sum(F.col("error")).alias("label_error")).withColumnRenamed("label", "_label")
    sha = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    both = found.join(by_label, found["label"].eqNullSafe(by_label["_label"]))
    return both.select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
