"""Exact k-means on bit planes: dot products as weighted popcounts.

A vector's 64 components, as integers in two's complement, become planes: bit b of all components in one unsigned
64-bit word, component c at bit c.  With x = sum of w_b X_b over its planes, w_b = 2^b and the last one -2^b, the dot
product of two vectors is the sum over pairs of planes of w_i w_j popcount(X_i & Y_j), and squared distances follow
from dot products.  All of it is whole numbers, so results do not depend on how rows are dealt.  The last plane is the
sign: repeating it changes nothing, so rows may have different numbers of planes.

A round is one pass over the planes.  Tasks assign their rows and count, for each centroid and plane, the bits of each
component; those counts, added up by Spark, are the exact sums that make the next centroids.  What the driver keeps
is the centroids.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

WIDTH = 64
_BLOCK = 4096
_SAFE = 28  # planes up to which 64-bit arithmetic holds squared distances of 64 components


def to_planes(x: np.ndarray) -> np.ndarray:
    """(rows, 64) whole numbers, as int64 or Python integers -> (rows, planes) of uint64, with as many planes as the largest needs."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    n = max(high.bit_length(), (-low - 1).bit_length() if low < 0 else 0) + 1
    out = np.empty((len(x), n), np.uint64)
    for b in range(n):
        bits = (x >> b & 1).astype(np.uint8)
        out[:, b] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def from_planes(planes: list[int]) -> list[int]:
    """The 64 components of one vector."""
    weights = plane_weights(len(planes))
    return [sum(w for w, p in zip(weights, planes) if p >> c & 1) for c in range(WIDTH)]


def plane_weights(n: int) -> list[int]:
    return [1 << b for b in range(n - 1)] + [-(1 << (n - 1))]


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact dot products of the rows of x (rows, planes) with those of y, as int64, or Python integers where 64 bits might not do."""
    wide = max(x.shape[1], y.shape[1]) > _SAFE
    out = np.zeros((len(x), len(y)), object if wide else np.int64)
    for j, wj in enumerate(plane_weights(y.shape[1])):
        for i, wi in enumerate(plane_weights(x.shape[1])):
            counts = np.bitwise_count(x[:, i, None] & y[None, :, j])
            out += counts.astype(object) * (wi * wj) if wide else counts.astype(np.int64) * (wi * wj)
    return out


def own_dots(x: np.ndarray) -> np.ndarray:
    """The exact dot product of each row with itself; each pair of planes is looked at once."""
    wide = x.shape[1] > _SAFE
    out, weights = np.zeros(len(x), object if wide else np.int64), plane_weights(x.shape[1])
    for i, wi in enumerate(weights):
        for j in range(i, len(weights)):
            counts = np.bitwise_count(x[:, i] & x[:, j])
            out += (counts.astype(object) if wide else counts.astype(np.int64)) * (wi * weights[j] * (1 if i == j else 2))
    return out


def nearest_centroids(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (ties: the smaller number) and the exact squared distance to it."""
    distance = own_dots(x)[:, None] + own_dots(centroids)[None, :] - 2 * dots(x, centroids)
    best = np.argmin(distance, axis=1)
    return best, distance[np.arange(len(x)), best]


def plane_counts(x: np.ndarray) -> np.ndarray:
    """(planes, 64): in how many rows each component has each bit."""
    bits = np.unpackbits(np.ascontiguousarray(x.T).astype("<u8").view(np.uint8).reshape(x.shape[1], len(x), 8), axis=2, bitorder="little")
    return bits.sum(axis=1, dtype=np.int64)


def _blocks(batch: pa.RecordBatch):
    """The planes of a batch as (first row, (rows, planes)), a bounded number of rows at a time, each with its rows' most planes."""
    column = batch.column("planes")
    for at in range(0, len(column), _BLOCK):
        part = column.slice(at, _BLOCK)
        flat, ends = part.flatten().to_numpy(zero_copy_only=False).view(np.uint64), part.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        n = int(ends.max())
        last = np.cumsum(ends) - 1
        where = np.minimum((last - ends + 1)[:, None] + np.arange(n), last[:, None])  # the sign again beyond a row's planes
        yield at, flat[where]


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, embedding) -> vec_id, planes of floor(scale * component), for vectors of exactly 64 components, none null or not finite.

    Products are in double precision, and the whole number below is exact whatever its size.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def run(batches):
        for batch in batches:
            column = batch.column("embedding")
            for at in range(0, len(column), _BLOCK):
                part, ids = column.slice(at, _BLOCK), batch.column("vec_id").slice(at, _BLOCK)
                flat = part.flatten()
                values = np.floor(flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, WIDTH) * scale)
                whole = values.astype(np.int64) if not values.size or np.abs(values).max() < 2.0**62 else np.array([[int(v) for v in row] for row in values], object)
                planes = to_planes(whole)
                change = np.hstack([np.ones((len(planes), 1), bool), planes[:, 1:] != planes[:, :-1]])
                width = planes.shape[1] - np.argmax(change[:, ::-1], axis=1)  # each row's own number of planes, whatever the others need
                flat = planes[np.arange(planes.shape[1]) < width[:, None]]
                offsets = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, flat.view(np.int64))], names=["vec_id", "planes"])

    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) * scale == float("inf")))
    return vectors.where((F.size("embedding") == WIDTH) & ~bad).mapInArrow(run, "vec_id long, planes array<long>")


def first_centroids(rows: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors whose SHA-256 of salt and vec_id (in decimal) is smallest; repeated ids in the order of their planes."""
    name = F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    drawn = rows.select("planes", F.sha2(name, 256).alias("_sha")).orderBy("_sha", "planes").limit(k).collect()
    return [from_planes([p & (1 << 64) - 1 for p in r["planes"]]) for r in sorted(drawn, key=lambda r: r["_sha"])]


def _array(centroids: list[list[int]]) -> np.ndarray:
    return to_planes(np.array(centroids, object))


def _assign(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    planes = _array(centroids)

    def run(batches):
        for batch in batches:
            for at, x in _blocks(batch):
                which, far = nearest_centroids(x, planes)
                far = [d if d < 1 << 63 else None for d in far.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").slice(at, len(x)), pa.array(which, pa.int32()), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

    return rows.mapInArrow(run, "vec_id long, cluster int, distance long")


def _sums(rows: DataFrame, centroids: list[list[int]]) -> tuple[list[int], list[list[int]]]:
    """The number of rows nearest to each centroid, and the exact sums of their components."""
    planes = _array(centroids)
    names = [f"c{c}" for c in range(WIDTH)]

    def run(batches):
        sizes, counts = np.zeros(len(planes), np.int64), {}
        for batch in batches:
            for _, x in _blocks(batch):
                which, n = nearest_centroids(x, planes)[0], x.shape[1]
                for k in np.unique(which).tolist():
                    mine = x[which == k]
                    sizes[k] += len(mine)
                    counts[k, n] = counts.get((k, n), 0) + plane_counts(mine)
        out = [(k, -1, -1, [int(s)] + [0] * (WIDTH - 1)) for k, s in enumerate(sizes) if s]
        out += [(k, n, b, row.tolist()) for (k, n), some in counts.items() for b, row in enumerate(some)]
        where = [pa.array([r[i] for r in out], pa.int32()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*where, *(pa.array([r[3][c] for r in out], pa.int64()) for c in range(WIDTH))], names=["k", "n", "b", *names])

    shape = "k int, n int, b int, " + ", ".join(f"{c} long" for c in names)
    added = rows.mapInArrow(run, shape).groupBy("k", "n", "b").agg(*(F.sum(c).alias(c) for c in names)).collect()  # centroids x planes
    sizes, sums = [0] * len(centroids), [[0] * WIDTH for _ in centroids]
    for r in added:
        if r["n"] < 0:
            sizes[r["k"]] += r["c0"]
        else:
            w = plane_weights(r["n"])[r["b"]]
            sums[r["k"]] = [s + w * r[c] for s, c in zip(sums[r["k"]], names)]
    return sizes, sums


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, salt: str = "3:") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, embedding) -> (vec_id, cluster, distance) and the final centroids, after so many rounds of exact k-means.

    A round replaces every centroid that has vectors by the whole number below each component's mean.  Vectors that
    are null, not of 64 components, or hold a null or non-finite one take no part.  Rows stay as often as they come; a
    null vec_id is hashed as an empty one; with fewer vectors than k there are as many centroids; an empty table gives
    an empty result; other columns are left out.  A squared distance beyond 64 bits is null (compared exactly).
    """
    rows = staged(quantised(vectors, scale), "planes")
    centroids = first_centroids(rows, k, salt)
    for _ in range(rounds if centroids else 0):
        sizes, sums = _sums(rows, centroids)
        centroids = [[s // n for s in total] if n else old for n, total, old in zip(sizes, sums, centroids)]
    if not centroids:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    return _assign(rows, centroids), centroids


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """cluster() -> vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: sums beyond 64 bits are null."""
    spark, most = assigned.sparkSession, (1 << 63) - 1
    found = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("lost")).collect()
    sums = {r["cluster"]: int(r["s"]) if not r["lost"] else most + 1 for r in found}
    own = [sums.get(c, 0) if sums.get(c, 0) <= most else None for c in range(len(centroids))]
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    about = spark.createDataFrame(list(zip(range(len(centroids)), own, shas)), "cluster int, cluster_inertia long, centroid_sha256 string")
    total = None if any(v is None for v in own) else sum(own)
    total = F.lit(total if total is not None and total <= most else None).cast("long")
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", total.alias("inertia"), "centroid_sha256")
