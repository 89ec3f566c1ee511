"""Centroid clustering of integer vectors by a bisector tournament.

For integer centroids a and b the vectors nearer to b lie on one side of the
plane x . (2b - 2a) = |b|^2 - |a|^2. Normals and thresholds of all pairs are
integers and are worked out once a round. A vector meets the centroids in
ascending number: the sign of one linear test says whether the next one beats
the best so far, zero favours the one with the smaller number, and after k - 1
tests one is left. Its squared distance is then computed exactly.

Everything is exact in 64-bit integers while no component is beyond `LARGEST`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabsmith.llm.common import c
from tabsmith.session import materialise

#: With 64 components of this size every test stays below 2 ** 63.
LARGEST = 1 << 27
#: Vectors that are compared at a time.
BLOCK = 2048


@dataclass
class Clustered:
    """Vectors (vec_id, cluster, distance) and, per centroid, its components."""

    rows: DataFrame
    centroids: list[list[int]]


def integer_vectors(vectors: DataFrame, dims: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): floor(scale * component) of the vectors with exactly `dims` finite components.

    Null vectors, other lengths, null, NaN and infinite components are left
    out. A component beyond `LARGEST` after scaling is an error, since its
    distances could not be exact.
    """
    x = c(vector_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    small = F.forall("x", lambda v: F.abs(v) <= LARGEST)
    ok = vectors.select(c(id_col).alias("vec_id"), x.alias("x")).filter((F.size("x") == dims) & finite)
    scaled = ok.withColumn("x", F.transform("x", lambda v: F.floor(v * F.lit(float(scale))).cast("double")))
    limit = F.raise_error(F.lit(f"a component is beyond {LARGEST}"))
    return scaled.select("vec_id", F.when(small, F.transform("x", lambda v: v.cast("int"))).otherwise(limit).alias("x"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The components of the k vectors with the smallest SHA-256 of seed and id; equal ids follow their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r["x"]) for r in vectors.select(key.alias("key"), "x").orderBy("key", "x").limit(k).collect()]


class Bisectors:
    """Normals and thresholds of all pairs of centroids."""

    def __init__(self, centroids: list[list[int]]):
        self.points = np.array(centroids, np.int64)
        squares = (self.points**2).sum(axis=1)
        self.normals = 2 * (self.points[None, :, :] - self.points[:, None, :])
        self.thresholds = squares[None, :] - squares[:, None]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The number of each row's nearest centroid, the smaller one of two equally near."""
        best = np.zeros(len(x), np.int64)
        for j in range(1, len(self.points)):
            side = np.einsum("ij,ij->i", x, self.normals[best, j])
            best[side > self.thresholds[best, j]] = j
        return best

    def distance(self, x: np.ndarray, number: np.ndarray) -> np.ndarray:
        return ((x - self.points[number]) ** 2).sum(axis=1)


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integer matrices of bounded height."""
    for batch in batches:
        for low in range(0, batch.num_rows, BLOCK):
            part = batch.slice(low, BLOCK)
            flat = part.column("x").flatten().to_numpy(zero_copy_only=False)
            yield part.column("vec_id"), flat.astype(np.int64).reshape(-1, dims)


def _sums(vectors: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """Per centroid that has vectors, their number and the sums of their components.

    A task adds up its own vectors, so at most k x dims rows leave it, and
    k x dims sums come to the driver.
    """
    dims = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = Bisectors(centroids)
        n, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dims), np.int64)
        for _, x in _blocks(batches, dims):
            best = pairs.nearest(x)
            n += np.bincount(best, minlength=len(n))
            np.add.at(total, best, x)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(seen, dims)), pa.array(np.tile(np.arange(dims), len(seen))), pa.array(np.repeat(n[seen], dims)), pa.array(total[seen].ravel())],
            names=["cluster", "dim", "n", "total"],
        )

    cells = vectors.select("vec_id", "x").mapInArrow(run, "cluster long, dim long, n long, total long")
    # Decimal sums cannot overflow, however many vectors there are.
    found = cells.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in found.collect():
        out.setdefault(r["cluster"], (r["n"], [0] * dims))[1][r["dim"]] = int(r["total"])
    return out


def _assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    dims = len(centroids[0])
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = Bisectors(centroids)
        for ids, x in _blocks(batches, dims):
            best = pairs.nearest(x)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(best.astype(np.int32)), pa.array(pairs.distance(x, best))], names=["vec_id", "cluster", "distance"]
            )

    return vectors.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2) -> Clustered:
    """Assign and move `rounds` times, then assign once more.

    `vectors` are (vec_id, x) as `integer_vectors` gives them; they are written
    once and read by every round. A centroid moves to the floor of the mean of
    its vectors, componentwise and exact; one without vectors stays. With
    fewer than k vectors there are as many centroids. Repeated vectors count
    as often as they occur; a null id is an id like any other. Without vectors
    there are no rows and no centroids.
    """
    stored = materialise(vectors, "vectors")
    centroids = first_centroids(stored, k, seed)
    if not centroids:
        kind = stored.schema["vec_id"].dataType.simpleString()
        return Clustered(stored.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long"), [])
    for _ in range(rounds):
        sums = _sums(stored, centroids)
        centroids = [[s // sums[i][0] for s in sums[i][1]] if i in sums else old for i, old in enumerate(centroids)]
    return Clustered(materialise(_assigned(stored, centroids), "clusters"), centroids)


def clustered_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, **options) -> DataFrame:
    """Cluster and distance of every vector that `integer_vectors` keeps.

    Columns: vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256. One row per kept row, repeated ids too; an empty table
    gives no rows. Columns other than the id and the vector are not read.
    """
    done = cluster(integer_vectors(vectors, **options), k, rounds, seed)
    # One row per centroid, at most k.
    per = done.rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    whole = sum(r["cluster_inertia"] for r in per)
    rows = [(r["cluster"], r["cluster_inertia"], whole, ",".join(map(str, done.centroids[r["cluster"]]))) for r in per]
    facts = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, _components string")
    facts = facts.select("cluster", "cluster_inertia", "inertia", F.sha2("_components", 256).alias("centroid_sha256"))
    return done.rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
