"""Approximate nearest neighbours by collision counting over single projections.

A block of vectors has one sorted array for each projection on an axis.  A query opens a window around its own value
in each of them; a vector collides once for each window that it is in.  Windows grow by virtual rehashing (the same
arrays, a wider radius, and only what the wider windows add is counted) until enough vectors have collided in most
projections; those over the collision threshold are verified by their cosine on the original vectors.

The axes are random rotations: the axes of one rotation are at right angles, so their collisions repeat less of each
other than those of independent axes do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, shuffle_partitions


def _matrix(column) -> np.ndarray:
    """Rows as doubles, each scaled by a power of two to at most 1 in size, which changes no cosine."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None])


def rotations(dim: int, projections: int, seed: int = 11) -> np.ndarray:
    """`projections` axes as columns: random rotations of space, one after another, of a length that makes unit differences have unit variance."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(-(-projections // dim)):
        out.append(np.linalg.qr(rng.standard_normal((dim, dim)))[0] * np.sqrt(dim))
    return np.concatenate(out, axis=1)[:, :projections]


def collision_search(base: np.ndarray, ids: np.ndarray, queries: np.ndarray, names: np.ndarray, k: int, projections: int = 128, needed: float = 0.65, verify: float = 0.02, grow: float = 1.5, count: list | None = None):
    """(query, vec_id, score) lists of the k best of a block for each query.

    A query's windows stop growing when `verify` of the block (k and 100 vectors at least) have collided in `needed`
    of the projections, or when the windows hold everything.  Those are verified whose collisions are not fewer than
    both that and the count of the last of so many (ties are all verified).  `count` collects how many were.
    """
    norms, asked = np.sqrt((base * base).sum(1)), np.sqrt((queries * queries).sum(1))
    axes = rotations(base.shape[1], projections)
    value, probe = (base / norms[:, None]) @ axes, (queries / asked[:, None]) @ axes
    order = np.argsort(value, axis=0)
    arrays = [np.ascontiguousarray(order[:, j]) for j in range(projections)]
    values = [value[a, j] for j, a in enumerate(arrays)]
    n, enough = len(base), min(len(base), max(k + 100, int(verify * len(base))))
    widest = max(v[-1] - v[0] for v in values) + np.ptp(probe) + 1
    least = int(np.ceil(needed * projections))
    out_q, out_v, out_s = [], [], []

    def verified(q: int, hits: np.ndarray) -> None:
        near = np.flatnonzero(hits >= max(least, np.partition(hits, n - enough)[n - enough]))
        near = near[ids[near] != names[q]]
        if count is not None:
            count.append(len(near))
        score = (base[near] * queries[q]).sum(1) / (norms[near] * asked[q])
        best = near[top := np.lexsort((ids[near], -score))[:k]]
        out_q.append(np.full(len(best), names[q]))
        out_v.append(ids[best])
        out_s.append(score[top])

    for first in range(0, len(queries), 64):  # so many at a time: their counts are a few MB
        some = np.arange(first, min(first + 64, len(queries)))
        bounds = lambda at, side, some: np.stack([np.searchsorted(v, at[some, j], side) for j, v in enumerate(values)], 1)
        low = high = bounds(probe, "left", some)
        hits, radius = np.zeros((len(some), n), np.int64), 0.05
        while len(some):
            new_low, new_high = bounds(probe - radius, "left", some), bounds(probe + radius, "right", some)
            grown = [np.stack(pair, 2).tolist() for pair in ((new_low, low), (high, new_high))]
            for i, (left, right) in enumerate(zip(*grown)):
                hits[i] += np.bincount(np.concatenate([a[x:y] for side in (left, right) for a, (x, y) in zip(arrays, side)]), minlength=n)
            done = (hits >= least).sum(1) >= enough if radius <= widest else np.ones(len(some), bool)
            for i in np.flatnonzero(done).tolist():
                verified(some[i], hits[i])
            some, hits, low, high = some[~done], hits[~done], new_low[~done], new_high[~done]
            radius *= grow
    return out_q, out_v, out_s


def _one_each(df: DataFrame) -> DataFrame:
    """One row for each vec_id: the smallest of its vectors.  Only ids are shuffled to see whether any repeats."""
    again = df.groupBy("vec_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("vec_id")
    if again.isEmpty():
        return df
    return df.join(again, "vec_id", "left_anti").unionByName(df.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v")))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 1 << 16, chunk: int = 1 << 14, part: int = 1 << 13) -> DataFrame:
    """(vec_id, embedding) and queries of the same columns -> query_id, rank, vec_id, score.

    Blocks of at most about `block` vectors meet chunks of at most about `chunk` queries, so no task holds more than
    one of each; a task searches its block by parts of `part` vectors, and the k best of the blocks are merged.

    A candidate with the query's own vec_id is not a neighbour.  Vectors that are null, zero or hold null or
    non-finite components take no part, nor do rows without a vec_id; vectors of different lengths never meet.  A
    vec_id in several rows counts once, with the smallest of its vectors (compared component by component).  Ties go
    to the smaller vec_id.  Empty tables give an empty result; other columns are left out.
    """
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    usable = lambda df: _one_each(df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(F.forall("v", fine) & F.exists("v", lambda x: x != 0), F.lit(False))))
    vectors, queries = usable(vectors), usable(queries)
    rows = vectors.count()
    blocks = max(1, -(-rows // block), min(shuffle_partitions(vectors.sparkSession), rows // part))
    chunks = max(1, -(-queries.count() // chunk))
    deal = lambda df, own, n, other, m: df.withColumn(own, bucket_of(n, "vec_id")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn("dim", F.size("v"))
    left, right = deal(vectors, "block", blocks, "chunk", chunks), deal(queries, "chunk", chunks, "block", blocks)

    def search(base: pa.Table, asked: pa.Table) -> pa.Table:
        found = [], [], []
        if len(asked):
            q, names = _matrix(asked["v"]), asked["vec_id"].to_numpy()
            pieces = -(-len(base) // part)
            for i in range(pieces):  # parts of equal size
                at, end = i * len(base) // pieces, (i + 1) * len(base) // pieces
                some = base.slice(at, end - at)
                for out, more in zip(found, collision_search(_matrix(some["v"]), some["vec_id"].to_numpy(), q, names, k)):
                    out += more
        cols = [np.concatenate(x) if x else np.array([]) for x in found]
        if len(base) > part:  # the k best of the whole block
            keep = np.lexsort((cols[1], -cols[2], cols[0]))
            first = np.flatnonzero(np.concatenate([[True], np.diff(cols[0][keep]) != 0])) if len(keep) else keep
            place = np.arange(len(keep)) - np.repeat(first, np.diff([*first, len(keep)]))
            cols = [c[keep[place < k]] for c in cols]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    keys = ("dim", "block", "chunk")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
