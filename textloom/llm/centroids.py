"""Centroid clustering with block-norm screening.

Vectors are kept as integers beside the norms of their segments, computed once. In each round the norms give a lower bound of
the squared distance from every centroid: by Cauchy-Schwarz, segment by segment, it is at least the
square of the norms' difference. The centroid of the least bound gets its exact distance, and so do those whose bound, less
its rounding error, is not above it; ties go to the smaller number. Results are those of plain rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.llm._spark import written
from textloom.llm._vectors import binaries, checked, from_binaries, integers, matrix

CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
COMPONENTS = 64
#: Components of a segment.
SEGMENT = 8
SEED = "3"
#: Of the sum of both squared lengths: more than rounding the norms to 32 bits can take from a bound.
MARGIN = 1e-6


@dataclass(frozen=True)
class Clusters:
    """rows: vec_id, cluster, distance, tried (exact distances of the last pass); centroids: one row each."""

    rows: DataFrame
    centroids: np.ndarray


def norms(x: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """The length of each segment; the last one may be shorter."""
    return np.sqrt(np.add.reduceat(x * x, np.arange(0, x.shape[1], segment), axis=1).astype(np.float64))


def nearest(x: np.ndarray, of: np.ndarray, centroids: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, exact squared distance, how many distances were computed) of rows x with the norms `of`."""
    own = norms(centroids, segment)
    a, b = (of * of).sum(1)[:, None], (own * own).sum(1)[None, :]
    bound = np.zeros((len(x), len(centroids)))
    for s in range(of.shape[1]):
        bound += (of[:, s, None] - own[None, :, s]) ** 2
    bound -= MARGIN * (a + b)
    first = bound.argmin(axis=1)
    at = np.arange(len(x))
    met = np.full(bound.shape, np.iinfo(np.int64).max)
    met[at, first] = ((x - centroids[first]) ** 2).sum(1)
    open_ = bound <= met[at, first][:, None]
    open_[at, first] = False
    i, j = np.nonzero(open_)
    met[i, j] = ((x[i] - centroids[j]) ** 2).sum(1)
    cluster = met.argmin(axis=1)  # the first of equals
    return cluster, met[at, cluster], 1 + np.bincount(i, minlength=len(x))


def _compressed(segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("x"))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), binaries(x.astype("<i4")), binaries(norms(x, segment).astype("<f4"))], names=["vec_id", "x", "norms"])

    return run


def _read(b: pa.RecordBatch, width: int, segment: int) -> tuple[np.ndarray, np.ndarray]:
    return from_binaries(b.column("x"), "<i4", width).astype(np.int64), from_binaries(b.column("norms"), "<f4", -(-width // segment)).astype(np.float64)


def _sums(centroids: np.ndarray, segment: int):
    """cluster, n, s of a partition: one row a cluster at most."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for b in batches:
            if b.num_rows:
                x, of = _read(b, width, segment)
                cluster, _, _ = nearest(x, of, centroids, segment)
                n += np.bincount(cluster, minlength=k)
                np.add.at(s, cluster, x)
        used = np.flatnonzero(n)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * width), pa.array(s[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), lists], names=["cluster", "n", "s"])

    return run


def _assigned(centroids: np.ndarray, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cluster, distance, tried = nearest(*_read(b, centroids.shape[1], segment), centroids, segment)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance), pa.array(tried, pa.int64())], names=["vec_id", "cluster", "distance", "tried"])

    return run


def cluster(table: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, components: int = COMPONENTS, segment: int = SEGMENT, seed: str = SEED, key: str = "vec_id", vector: str = "embedding") -> Clusters | None:
    """The clusters of all vectors with so many components, none null or not finite; None if there is no vector.

    Centroids begin as the vectors whose sha256 of seed:id is smallest; equal ids by their components, null ids last. With fewer vectors there are fewer
    centroids. Rows that share an id are rows of their own. Each round reads the compressed vectors once and sends
    sums of a row a cluster; nothing is kept of a row between rounds.
    """
    rows = integers(table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v")), scale, "v", "vec_id").where(F.size("x") == components)
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.withColumn("h", h).orderBy(F.col("h").asc_nulls_last(), "x").select("x").limit(clusters).collect()
    if not first:
        return None
    centroids = checked(np.array([r["x"] for r in first], np.int64))
    held = written(rows.mapInArrow(_compressed(segment), "vec_id long, x binary, norms binary"), "vectors")
    for _ in range(rounds):
        partial = held.select("x", "norms").mapInArrow(_sums(centroids, segment), "cluster int, n long, s array<long>")
        sums = partial.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[d]) for d in range(components)]).alias("s"))
        centroids = centroids.copy()
        for r in sums.collect():
            centroids[r["cluster"]] = np.array(r["s"], np.int64) // r["n"]
    return Clusters(written(held.mapInArrow(_assigned(centroids, segment), "vec_id long, cluster int, distance long, tried long"), "clusters"), centroids)


def digest(table: DataFrame, **how) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, distances (computed in the last pass) of every vector that takes part. Without vectors there are no rows."""
    spark, found = table.sparkSession, cluster(table, **how)
    if found is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, distances long")
    by = {r["cluster"]: r["d"] for r in found.rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    name = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    notes = spark.createDataFrame([(c, d, sum(by.values()), name(found.centroids[c].tolist())) for c, d in by.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row a cluster.
    return found.rows.join(F.broadcast(notes), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", F.col("tried").alias("distances"))
