"""Operator 13: centroid clustering by sort-means, in whole numbers.

Vectors with exactly `size` components, none null or non-finite, are kept; each component becomes floor(size * x). Centroids
0, 1, ... start as the `k` kept vectors of the smallest sha256 of "1:<vec_id>", in ascending order of it (ties, as of repeated
rows, by the components). Each round assigns every vector to the nearest centroid (ties: the smaller number) and replaces
each centroid that has vectors by their componentwise floor of the mean; then vectors are assigned once more.

Sort-means: for each centroid the others are listed by ascending distance from it. A vector starts at the centroid it was
assigned to before and goes down that one's list; it stops at the first centroid that lies strictly beyond twice the vector's
distance from where it started, as by the triangle inequality none from there on can be nearer, nor as near. (Exactly twice
may tie with a smaller number, so it goes on.) The first round starts at centroid 0.

Vectors and their assignments are a table in the shared folder, written anew in each round; the driver holds the centroids
only (k * size numbers), whatever the number of vectors. Sums are exact: longs where the largest component times the number
of vectors fits, decimals otherwise.

Null and other vectors that are not kept give no row. A null vec_id has no hash: its vector is assigned, but starts no
centroid. Repeated rows each count. With fewer than k vectors there are as many centroids as vectors with an id; without any,
no rows. Other columns do not matter. A component beyond LARGEST in absolute value (x beyond two million) would make squared
distances pass 64 bits: the job then stops with an error, as no row could hold the distance asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import written

#: Components of a vector, centroids, rounds.
SIZE, CENTROIDS, ROUNDS = 64, 16, 3
#: Largest absolute component: size * (2 * LARGEST)^2 stays below 2^63.
LARGEST = 1 << 27
#: Vectors that are compared at a time.
BLOCK = 4096


def kept(vectors: DataFrame, size: int = SIZE) -> DataFrame:
    """vec_id, v (whole numbers as longs) and largest, the greatest absolute component, of the vectors that are kept."""
    x = F.col("embedding")
    sound = F.expr("forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    rows = vectors.filter((F.size(x) == size) & sound).select("vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * size)).alias("w"))
    # floor() of a double beyond a long gives its end, which is beyond LARGEST as well
    rows = rows.select("vec_id", F.col("w").cast("array<long>").alias("v"))
    return rows.withColumn("largest", F.expr("aggregate(v, 0L, (s, c) -> greatest(s, c, -1L - c))"))


def first_centroids(rows: DataFrame, k: int) -> np.ndarray:
    named = rows.filter("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    return np.array([r.v for r in named.orderBy("h", "v").limit(k).collect()], dtype=np.int64)


def assigned(v: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroids and squared distances of vectors, from their centroids before; and how many distances were worked out."""
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    nearest, least, worked = before.copy(), ((v - centroids[before]) ** 2).sum(axis=1), len(v)
    for c in np.unique(before).tolist():
        rows = np.flatnonzero(before == c)
        bound = 4 * least[rows].astype(object) if len(rows) and int(least[rows].max()) >= 1 << 60 else 4 * least[rows]
        for j in np.argsort(apart[c], kind="stable").tolist():
            if j == c:
                continue
            going = (apart[c, j] <= bound).astype(bool)
            rows, bound = rows[going], bound[going]
            if not len(rows):
                break
            far = ((v[rows] - centroids[j]) ** 2).sum(axis=1)
            worked += len(rows)
            nearer = (far < least[rows]) | ((far == least[rows]) & (j < nearest[rows]))
            least[rows[nearer]], nearest[rows[nearer]] = far[nearer], j
    return nearest, least, worked


def assignment(rows: DataFrame, centroids: np.ndarray, size: int) -> DataFrame:
    """rows (vec_id, v and cluster, the one before) with their cluster now and the squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                v = part.column("v").flatten().to_numpy().reshape(-1, size)
                nearest, least, _ = assigned(v, part.column("cluster").to_numpy(), centroids)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), pa.array(nearest), pa.array(least)], ["vec_id", "v", "cluster", "distance"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "v", F.col("cluster").cast("long")).mapInArrow(run, f"vec_id {kind}, v array<long>, cluster long, distance long")


def moved(rows: DataFrame, centroids: np.ndarray, wide: bool) -> np.ndarray:
    """Centroids replaced by the floor of the means of their vectors; those without vectors stay."""
    kind = "decimal(38,0)" if wide else "long"
    sums = rows.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[i].cast(kind)).alias(f"s{i}") for i in range(centroids.shape[1])])
    out = centroids.copy()
    for r in sums.collect():
        out[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(centroids.shape[1])]
    return out


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256."""
    start = written(kept(vectors, size), "vectors")
    count, largest = start.agg(F.count("*"), F.max("largest")).first()
    if count and largest > LARGEST:
        raise ValueError(f"a component of {size} * x is {largest} or more in absolute value; squared distances fit 64 bits up to {LARGEST}")
    centroids = first_centroids(start, k) if count else np.zeros((0, size), dtype=np.int64)
    if not len(centroids):
        return start.filter("false").selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    rows = start.withColumn("cluster", F.lit(0))
    for _ in range(rounds):
        rows = written(assignment(rows, centroids, size), "assigned")
        centroids = moved(rows, centroids, int(largest) * count >= 1 << 62)
    rows = written(assignment(rows, centroids, size).drop("v"), "assigned")
    per = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("i")).collect()
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    total = sum(int(r.i) for r in per)
    known = rows.sparkSession.createDataFrame([(int(r.cluster), int(r.i), total, shas[r.cluster]) for r in per], "cluster long, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(known), "cluster").select("vec_id", F.col("cluster").cast("int").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")
