"""Centroid clustering with a pivot table: stored distances to fixed pivots rule out most centroids in every round.

For any pivot p, |d(v, p) - d(c, p)| is at most d(v, c).  The distances of all vectors to the pivots are stored once; a
round computes those of the few centroids, and only centroids whose bound does not exceed the distance to the most
promising one get an exact distance, in whole numbers.  Tasks send sums and counts by centroid, never vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.llm.common import written

#: Whole components are held to this size, so that a squared distance fits a long.
LIMIT = 1 << 27
PIVOTS = 8
#: Rows that are compared with all centroids at once.
BLOCK = 4096


def whole_vectors(vector: Column, dims: int, scale: int) -> Column:
    """The vector as whole numbers floor(scale * x), at most LIMIT in size; null for one that is not of dims finite numbers."""
    clean = (F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    scaled = F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int"))
    return F.when(vector.isNotNull() & clean, scaled)


def spread_pivots(centroids: np.ndarray, n: int) -> np.ndarray:
    """n of the rows, each the farthest from those before it; the first is the farthest from the mean."""
    far = ((centroids - centroids.mean(axis=0)) ** 2).sum(axis=1)
    chosen, near = [int(far.argmax())], None
    while len(chosen) < min(n, len(centroids)):
        d = ((centroids - centroids[chosen[-1]]) ** 2).sum(axis=1)
        near = d if near is None else np.minimum(near, d)
        chosen.append(int(near.argmax()))
    return centroids[chosen]


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=1)


def nearest(vectors: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance) of each vector, ties to the smaller number, and how many exact distances it took."""
    of_centroids = np.sqrt(((centroids[:, None, :] - pivots[None]) ** 2).sum(axis=2).astype(np.float64))
    bound = np.zeros((len(vectors), len(centroids)))
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(to_pivots[:, p:p + 1] - of_centroids[None, :, p]), out=bound)
    first = bound.argmin(axis=1)
    best = exact(vectors, centroids[first])
    # rounding must not drop a centroid that is as near: the bound is compared with a margin
    limit = np.sqrt(best.astype(np.float64)) * (1 + 1e-9) + 1e-6
    row, c = np.nonzero(bound <= limit[:, None])
    d = exact(vectors[row], centroids[c])
    order = np.lexsort((c, d, row))
    row, starts = np.unique(row[order], return_index=True)
    return c[order][starts].astype(np.int32), d[order][starts], len(d) + len(first)


class Clusters(NamedTuple):
    """assigned has key, cluster (int) and distance (long, squared); exact counts the exact distances of each round."""

    assigned: DataFrame
    centroids: list[list[int]]
    exact: list[int]


def pivot_clusters(table: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = 40, rounds: int = 5,
                   dims: int = 64, scale: int = 256, salt: str = "2:") -> Clusters:
    """Lloyd's rounds over whole-number vectors.

    Rows whose vector is null, of another size, or holds a null or a non-finite component are left out.  The first
    centroids are the vectors with the smallest sha256 of salt and key (null key: empty; equal keys: by vector); a table
    with fewer vectors has as many centroids, an empty one none.  Equal vectors may be centroids at once; then the
    smaller number takes the rows and the other stays.  Keys may repeat; other columns are left out.  Components beyond
    LIMIT / scale in size count as that bound.
    """
    kind = table.schema[key].dataType.simpleString()
    kept = table.select(F.col(key).alias("key"), whole_vectors(F.col(vector), dims, scale).alias("v")).filter("v IS NOT NULL")
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("key").cast("string"), F.lit(""))).cast("binary"), 256)
    start = kept.orderBy(digest, "v").limit(clusters).select("v").collect()
    if not start:
        return Clusters(table.sparkSession.createDataFrame([], f"{key} {kind}, cluster int, distance long"), [], [])
    centroids = np.array([r.v for r in start], np.int64)
    pivots = spread_pivots(centroids, PIVOTS)

    def matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1), np.int64, dims)
            d = np.sqrt(np.stack([exact(v, p[None]) for p in pivots], axis=1).astype(np.float64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * len(pivots), pa.int32()), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["key", "v", "to_pivots"])

    stored = written(kept.mapInArrow(measure, f"key {kind}, v array<int>, to_pivots array<double>"))

    def found(batch: pa.RecordBatch, now: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, int]]:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            v = matrix(part.column(1), np.int64, dims)
            yield part, v, *nearest(v, matrix(part.column(2), np.float64, len(pivots)), now, pivots)

    def sums_with(now: np.ndarray):
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n, tried = np.zeros((len(now), dims), np.int64), np.zeros(len(now), np.int64), 0
            for batch in batches:
                for _, v, cluster, _, exacts in found(batch, now):
                    order = np.argsort(cluster, kind="stable")
                    which, starts = np.unique(cluster[order], return_index=True)
                    total[which] += np.add.reduceat(v[order], starts, axis=0)
                    n += np.bincount(cluster, minlength=len(now))
                    tried += exacts
            yield pa.RecordBatch.from_pydict({"cluster": np.arange(len(now), dtype=np.int32), "n": n, "sums": list(total), "exact": np.where(np.arange(len(now)) == 0, tried, 0)})

        return sums

    def assign_with(now: np.ndarray):
        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, _, cluster, d, _ in found(batch, now):
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cluster), pa.array(d)], names=["key", "cluster", "distance"])

        return assign

    tried = []
    for _ in range(rounds):
        parts = stored.mapInArrow(sums_with(centroids), "cluster int, n long, sums array<long>, exact long")
        # one row for each centroid, whatever the size of the input; decimals, for sums of very many rows
        moved = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("exact").alias("exact"), F.array(
            *[F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")) for i in range(dims)]).alias("sums")).collect()
        tried.append(sum(r.exact for r in moved))
        centroids = centroids.copy()
        for r in moved:
            if r.n:
                centroids[r.cluster] = [int(s) // r.n for s in r.sums]
    assigned = written(stored.select("key", "v", "to_pivots").mapInArrow(assign_with(centroids), f"key {kind}, cluster int, distance long"))
    return Clusters(assigned.withColumnRenamed("key", key), centroids.tolist(), tried)


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
