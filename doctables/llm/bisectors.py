"""Centroid clustering of integer vectors by a tournament of bisectors.

For every two centroids a < b the bisector is kept as an integer normal 2 (b - a) and a threshold |b|^2 - |a|^2: a vector lies nearer to b
exactly if its product with the normal is above the threshold, and a product equal to it favours a. So k - 1 sign tests eliminate all
centroids but the nearest one, without a distance; the distance to that one is taken last, and everything is exact. Centroids are k vectors,
so they travel with the tasks; their sums come back as at most k rows, pre-aggregated in every task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctables.llm.common import renamed
from doctables.sinks.stored import stored

SCALE = 64
#: Components beyond this would make distances that a long does not hold.
LARGEST = 1 << 27
BLOCK_ROWS = 2048
KEPT = "vec_id long, components binary"
PLACED = "vec_id long, cluster int, distance long"
PLACED_ARROW = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


class Bisectors:
    """Normals and thresholds of all pairs of centroids."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = np.array(centroids, np.int64).reshape(len(centroids), -1 if centroids else 0)
        self.k = len(centroids)
        norms = (self.centroids**2).sum(axis=1)
        a, b = (x.ravel() for x in np.indices((self.k, self.k)))
        self.normals = 2 * (self.centroids[b] - self.centroids[a])
        self.thresholds = norms[b] - norms[a]

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        """The number of the nearest centroid of each vector, the smaller number on a tie."""
        winner = np.zeros(len(vectors), np.int64)
        for rival in range(1, self.k):
            pair = winner * self.k + rival
            product = np.einsum("ij,ij->i", vectors, self.normals[pair])
            winner[product > self.thresholds[pair]] = rival
        return winner

    def distance(self, vectors: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        apart = vectors - self.centroids[cluster]
        return np.einsum("ij,ij->i", apart, apart)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integer vectors of a few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            raw = b"".join(part.column("components").to_pylist())
            yield part.column("vec_id"), np.frombuffer(raw, "<i4").reshape(-1, width).astype(np.int64)


def integer_vectors(vectors: DataFrame, width: int = 64, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id and ``components`` (floor(64 x) as little-endian 32-bit integers) of the vectors with ``width`` components, none null or not finite.

    Others are left out. A component of 2**27 or more after scaling is an error, because its distances fit in no long.
    """
    table = renamed(vectors, {"vec_id": id_column, "vector": vector_column}).select(F.col("vec_id").cast("long"), F.col("vector").cast("array<double>"))

    def converted(batches):
        for batch in batches:
            full = pc.fill_null(pc.equal(pc.list_value_length(batch.column("vector")), width), False)
            batch = batch.filter(full)
            values = pc.fill_null(pc.list_flatten(batch.column("vector")), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, width)
            good = np.isfinite(values).all(axis=1)
            scaled = np.floor(SCALE * values[good])
            if (np.abs(scaled) >= LARGEST).any():
                raise ValueError(f"a component of {LARGEST / SCALE} or more: its distances do not fit in a long")
            raw = scaled.astype("<i4").tobytes()
            offsets = np.arange(len(scaled) + 1, dtype=np.int32) * (4 * width)
            components = pa.Array.from_buffers(pa.binary(), len(scaled), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(good)), components], names=["vec_id", "components"])

    return table.mapInArrow(converted, KEPT)


def first_centroids(points: DataFrame, k: int, width: int) -> list[list[int]]:
    """The vectors with the smallest sha256 of ``1:<vec_id>``, in order; of equal ids those with smaller bytes first. Vectors without id start none."""
    hashed = points.filter("vec_id is not null").select(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("h"), "components")
    return [np.frombuffer(bytes(r.components), "<i4").tolist() for r in hashed.orderBy("h", "components").limit(k).collect()]


def moved(points: DataFrame, bisectors: Bisectors, width: int) -> list[list[int]]:
    """Every centroid with vectors becomes the componentwise floor of their mean; the others stay."""
    kind = "cluster int, n long, sums array<long>"

    def summed(batches):
        n, sums = np.zeros(bisectors.k, np.int64), np.zeros((bisectors.k, width), np.int64)
        for _, vectors in _blocks(batches, width):
            cluster = bisectors.nearest(vectors)
            n += np.bincount(cluster, minlength=bisectors.k)
            for c in np.unique(cluster):
                sums[c] += vectors[cluster == c].sum(axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    exact = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    centroids = bisectors.centroids.tolist()
    for row in points.mapInArrow(summed, kind).groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect():
        centroids[row.cluster] = [int(row[f"s{i}"]) // row.n for i in range(width)]
    return centroids


def placed(points: DataFrame, bisectors: Bisectors, width: int) -> DataFrame:
    """vec_id, cluster, distance (squared) of every vector."""

    def assign(batches):
        for ids, vectors in _blocks(batches, width):
            cluster = bisectors.nearest(vectors)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(bisectors.distance(vectors, cluster))], schema=PLACED_ARROW)

    return points.mapInArrow(assign, PLACED)


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid (its components), centroid_sha256.

    With fewer than ``k`` vectors every one starts a centroid. Vectors without id are placed but start none; repeated rows all count. Without
    any vector with an id there is no centroid, and the result is empty. ``k`` normals for each of ``k`` centroids go to every task.
    """
    spark = vectors.sparkSession
    points = stored(integer_vectors(vectors, width, id_column, vector_column))
    centroids = first_centroids(points, k, width)
    for _ in range(rounds if centroids else 0):
        centroids = moved(points, Bisectors(centroids), width)
    if not centroids:
        points = points.limit(0)
    assigned = stored(placed(points, Bisectors(centroids), width))
    inertia = {r.cluster: int(r.d) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    total = sum(inertia.values())
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    rows = [(c, inertia.get(c, 0), total, v, digest(v)) for c, v in enumerate(centroids)]
    # k rows, whatever the number of vectors
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")
