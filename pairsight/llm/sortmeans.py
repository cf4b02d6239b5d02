"""Centroid clustering by sort-means.

In each round the other centroids of every centroid are put in order of their distance from it. A vector starts at the
centroid that it had and goes through that order until a centroid is strictly farther than twice the vector's distance
from where it started: by the triangle inequality all that follow are farther from the vector than that, so neither they
nor a tie among them can win. Distances are squared integers, so "twice" is four times, and nothing is rounded.

Each round writes its vectors with their centroids to the shared folder, and with them what each task adds to the sums,
so a task that runs again counts once; the sums are read back by themselves and the round before is removed.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import remove_folder, shared_folder
from .vectors import MOST_LONG, integers, whole

#: Components, and what they are multiplied by before they are rounded down.
DIMENSIONS, SCALE = 64, 1024
CENTROIDS, ROUNDS, SEED = 8, 10, "3:"
#: Centroids are held by every task and the driver, so there is a bound to what they take.
MOST_CENTROID_VALUES = 1 << 20


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.square(a - b).sum(axis=-1)


def orders(centroids: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each centroid the others as (squared distance, number), nearest first."""
    return [sorted((int(d), j) for j, d in enumerate(squared(centroids, c)) if j != i) for i, c in enumerate(centroids)]


def nearest(vectors: np.ndarray, before: np.ndarray, centroids: np.ndarray, order: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Each vector's nearest centroid (of equally near ones the smallest number), its squared distance, and how many distances were computed. before: where each vector's search starts."""
    best, least, computed = before.copy(), np.empty(len(vectors), np.int64), 0
    for c in np.unique(before):
        rows = np.flatnonzero(before == c)
        start = squared(vectors[rows], centroids[c])
        computed += len(rows)
        near, at = start.copy(), np.full(len(rows), c, best.dtype)
        for between, other in order[c]:
            active = np.flatnonzero(between <= 4 * start)
            if not len(active):
                break
            d = squared(vectors[rows[active]], centroids[other])
            computed += len(active)
            wins = (d < near[active]) | ((d == near[active]) & (other < at[active]))
            near[active[wins]], at[active[wins]] = d[wins], other
        best[rows], least[rows] = at, near
    return best, least, computed


def sort_means(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, list[list[int]]]:
    """A row for each vector that is kept (vec_id, cluster, distance), and the final centroids.

    Kept are vectors with exactly ``dimensions`` components, none null or non-finite; components become
    floor(scale * x). The first centroids are the k kept vectors with the smallest hex sha256 of ``<seed><vec_id>``, in
    that order, null ids last, of equal ids the smaller vector; where fewer are kept there are fewer centroids. Rows that
    repeat are vectors of their own. An empty centroid stays. Other columns are ignored. k times dimensions is bounded
    by MOST_CENTROID_VALUES.
    """
    if k < 1 or k * dimensions > MOST_CENTROID_VALUES:
        raise ValueError(f"k * dimensions must be at least 1 and at most {MOST_CENTROID_VALUES}")
    spark = df.sparkSession
    kept = df.where((F.size(vector) == dimensions) & whole(F.col(vector))).select(F.col(vec_id).alias("vec_id"), integers(F.col(vector), scale).alias("ints"))
    hashed = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.orderBy(hashed.asc_nulls_last(), "ints").limit(k).collect()
    centroids = [list(r["ints"]) for r in first]
    schema = StructType([StructField("vec_id", kept.schema["vec_id"].dataType), StructField("ints", ArrayType(IntegerType())), StructField("cluster", IntegerType()), StructField("distance", LongType()), StructField("sums", ArrayType(LongType()))])
    state, folder = kept.withColumn("cluster", F.lit(0)), f"{shared_folder(spark)}/means-{uuid.uuid4().hex}"

    def assign(now: list[list[int]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.array(now, np.int64).reshape(-1, dimensions)
            order, total, ids = orders(table), np.zeros((len(table), dimensions + 1), np.int64), None
            for batch in batches:
                ints, ids = batch.column("ints"), batch.column("vec_id")
                vectors = ints.flatten().to_numpy().astype(np.int64).reshape(-1, dimensions)
                best, least, _ = nearest(vectors, batch.column("cluster").to_numpy(), table, order)
                np.add.at(total, best, np.hstack([vectors, np.ones((len(vectors), 1), np.int64)]))
                yield pa.RecordBatch.from_arrays([ids, ints, pa.array(best, pa.int32()), pa.array(least), pa.nulls(len(batch), pa.list_(pa.int64()))], names=schema.names)
            if ids is not None:
                used = np.flatnonzero(total[:, -1])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(used), ids.type), pa.nulls(len(used), ints.type), pa.array(used, pa.int32()), pa.nulls(len(used), pa.int64()), pa.array(total[used].tolist(), pa.list_(pa.int64()))], names=schema.names)

        return run

    for n in range(rounds + 1 if centroids else 1):
        state.select("vec_id", "ints", "cluster").mapInArrow(assign(centroids), schema).write.parquet(f"{folder}/{n}")
        written = spark.read.schema(schema).parquet(f"{folder}/{n}")
        if n:
            remove_folder(spark, f"{folder}/{n - 1}")
        state = written.where("sums IS NULL")
        if n < rounds:
            parts = written.where("sums IS NOT NULL").select("cluster", F.posexplode("sums").alias("at", "x"))
            sums = {(r["cluster"], r["at"]): int(r["x"]) for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()}
            centroids = [[sums[i, j] // sums[i, dimensions] for j in range(dimensions)] if (i, dimensions) in sums else c for i, c in enumerate(centroids)]
    return state.select("vec_id", "cluster", "distance"), centroids


def cluster_digest(df: DataFrame) -> DataFrame:
    """A row for each vector kept: vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256. Sums that a long can't hold are the largest long."""
    found, centroids = sort_means(df)
    by_cluster = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    every = min(MOST_LONG, sum(by_cluster.values()))
    sha = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    rows = [(i, min(MOST_LONG, by_cluster.get(i, 0)), every, sha(c)) for i, c in enumerate(centroids)]
    totals = df.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
