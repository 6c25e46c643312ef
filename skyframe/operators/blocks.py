"""Reductions over the neighbours of each row: places instead of rows, and cells as blocks of arrays.

Joining rows makes a row of every pair.  Here rows at one place become one row with their sums first, and a task takes
the places of a cell with all places in reach as arrays, so a pair costs a few array operations and is never a row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def placed(rows: DataFrame, dims: list[str], box: float) -> DataFrame:
    """Rows with their positions brought into [0, box) (0: open space); those without a position are left out."""
    x = F.col
    inside = {d: F.when(F.pmod(x(d), F.lit(float(box))) < box, F.pmod(x(d), F.lit(float(box)))).otherwise(0.0) if box else x(d).cast("double") for d in dims}
    return rows.where(reduce(lambda a, b: a & b, (F.col(d).isNotNull() for d in dims))).withColumns(inside)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _dealt(df: DataFrame, sizes: DataFrame, cell: list[str], dims: list[str], own: str, other: str) -> DataFrame:
    """Rows with a block of their own, by place, once for each block of the other side."""
    n = lambda k: F.coalesce(f"_n{k}", F.lit(1))
    df = df.join(sizes, cell, "left").withColumn(f"_b{own}", F.pmod(F.xxhash64(*dims), n(own)).cast("int"))
    return df.withColumn(f"_b{other}", F.explode(F.sequence(F.lit(0), (n(other) - 1).cast("int")))).drop("_nc", "_np")


def reduce_within(centers: DataFrame, points: DataFrame, dims: list[str], box: float, radius: float, fn: Callable, schema: str, closed: bool = True, crowd: tuple[int, int | None] = (20_000, 400_000)) -> DataFrame:
    """fn's rows for blocks of centers and of the points within `radius` of them; positions as of placed().

    fn(c, p, near, rows) gets dicts of arrays, of the columns of a block's centers and points; near(i): the numbers of
    the places of points within reach of center i, and their distances; rows(places, *more): the numbers of their points
    in p, and what goes along with each place.  Where points are places, that changes nothing.  fn returns a dict of
    arrays as in `schema`.
    Points are sent to all cells within their reach.  Cells with over crowd[0] centers or crowd[1] points are dealt into
    blocks; the caller puts the parts of a center together, or sets crowd[1] to None, so that a center comes once.
    """
    n = int(box // radius) if box else 0
    images = n > 2 or not box  # else a cell is its own neighbour on both sides, and the nearest image is found by distance
    n = n if images else 1
    size, box, wide, limit = (box / n if box else float(radius)), float(box), radius * (1 + 1e-9), radius * radius
    cell = [f"_g{d}" for d in dims]
    own = {f"_g{d}": F.least(F.floor(F.col(d) / F.lit(size)), F.lit(n - 1)) if box else F.floor(F.col(d) / F.lit(size)) for d in dims}
    c, p = centers.withColumns(own), points.select(*(F.col(k).alias(k) for k in points.columns)).withColumns(own)  # aliased, as both may come from the same columns
    for d in dims if images else ():
        x, g = F.col(d), F.col(f"_g{d}")
        p = p.withColumn(f"_g{d}", F.explode(F.array_compact(F.array(F.when(x - wide < g * F.lit(size), g - 1), g, F.when(x + wide >= (g + 1) * F.lit(size), g + 1)))))
        if box:
            p = p.withColumns({d: F.when(g < 0, x + box).when(g >= n, x - box).otherwise(x), f"_g{d}": F.pmod(g, F.lit(n))})
    one, none = F.count(F.lit(1)), F.lit(0).cast("long")
    sizes = c.groupBy(*cell).agg(one.alias("_c"), none.alias("_p")).unionByName(p.groupBy(*cell).agg(none.alias("_c"), one.alias("_p")))
    blocks = lambda k, most: F.greatest(F.ceil(F.sum(k) / F.lit(most)), F.lit(1)) if most else F.lit(1).cast("long")
    sizes = sizes.groupBy(*cell).agg(blocks("_c", crowd[0]).alias("_nc"), blocks("_p", crowd[1]).alias("_np")).where("_nc > 1 or _np > 1")
    c, p = _dealt(c, sizes, cell, dims, "c", "p"), _dealt(p, sizes, cell, dims, "p", "c")
    keys, kinds = [*cell, "_bc", "_bp"], _arrow(schema)

    def arrays(table: pa.Table) -> dict:
        return {k: table[k].to_numpy() for k in table.column_names if not k.startswith("_")}

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return kinds.empty_table()
        a, b = arrays(left), arrays(right)
        order = np.lexsort([b[d] for d in reversed(dims)])
        b = {k: v[order] for k, v in b.items()}
        first = np.flatnonzero(reduce(np.logical_or, (np.diff(b[d], prepend=np.nan) != 0 for d in dims)))
        many, at = np.diff(first, append=len(order)), [b[d][first] for d in dims]

        def near(i: int):
            x = a[dims[0]][i]
            lo, hi = np.searchsorted(at[0], (x - wide, x + wide)) if images else (0, len(first))
            sq = 0.0
            for d, place in zip(dims, at):
                gap = place[lo:hi] - a[d][i]
                if not images:
                    gap = np.where(gap > box / 2, gap - box, np.where(gap < -box / 2, gap + box, gap))
                gap *= gap
                sq = np.add(sq, gap, out=gap)
            found = np.flatnonzero(sq <= limit if closed else sq < limit)
            return found + lo, np.sqrt(sq[found])

        def rows(found: np.ndarray, *more: np.ndarray) -> tuple:
            if len(first) == len(order):
                return found, *more
            n = many[found]
            return np.repeat(first[found] - (np.cumsum(n) - n), n) + np.arange(n.sum()), *(np.repeat(x, n) for x in more)

        out = fn(a, b, near, rows)
        return pa.table([pa.array(out[f.name], f.type, from_pandas=False) for f in kinds], schema=kinds)

    parts = int(c.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return c.repartition(parts, *keys).groupBy(*keys).cogroup(p.repartition(parts, *keys).groupBy(*keys)).applyInArrow(block, schema)


def bin_of(edges: list[float], closed: str) -> Callable:
    """A function of distances: their bins (edge, next edge] if closed is "right", 0 in the first; else [edge, next edge); -1 or more than there are outside."""
    cuts = np.asarray(edges, float)

    def bins(d: np.ndarray) -> np.ndarray:
        k = np.searchsorted(cuts, d, "left" if closed == "right" else "right") - 1
        return np.where(d == 0, 0, k) if closed == "right" and cuts[0] == 0 else k

    return bins


def around(rows: DataFrame, dims: list[str], box: float, edges: list[float], sums: dict[str, Column], tops: dict[str, Column] = {}, lows: dict[str, Column] = {}, closed: str = "left", weight: Callable | None = None, tag: Column | None = None, asked: Column | None = None) -> DataFrame:
    """For each place of `rows` and bin of distance (`edges` from 0): what the rows at other places there add up to.

    Returns (dims, bin, tag, n, sums, tops, lows, n0, and sums again with 0 behind their names): n rows in a bin at
    other places, their sums, greatest and least values; in the first bin also the number and the sums of the rows at
    the very place, for a row there to take itself off.  A bin with neither has no row.  `weight`, of the distance,
    multiplies the sums, but not n.  `tag`, a whole number of rows, separates them further; `asked` chooses the centers.
    """
    rows, dims = placed(rows, dims, box), list(dims)
    tagged = tag is not None
    sums = {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in sums.items()}
    far = {**{k: (F.max, v, -np.inf) for k, v in tops.items()}, **{k: (F.min, v, np.inf) for k, v in lows.items()}}
    points = rows.groupBy(*dims, *([tag.cast("long").alias("tag")] if tagged else [])).agg(F.count(F.lit(1)).alias("n"), *(F.sum(v).alias(k) for k, v in sums.items()), *(F.coalesce(f(v), F.lit(none)).alias(k) for k, (f, v, none) in far.items()))
    centers = (rows if asked is None else rows.where(asked)).select(*dims).distinct()
    bins, last, names = bin_of(edges, closed), len(edges) - 1, list(sums)
    best = {**{k: np.maximum for k in tops}, **{k: np.fmin for k in lows}}

    def fn(c, p, near, members):
        labels, tags = np.unique(p["tag"], return_inverse=True) if tagged else (np.zeros(1, int), None)
        width, found, parts = len(labels), [], {k: [] for k in ["n", *names, *best]}
        for i in range(len(c[dims[0]])):
            at, d = near(i)
            k = bins(d)
            keep = (d > 0) & (k < last)
            at, d, k = at[keep], d[keep], k[keep]
            if tagged:
                at, d, k = members(at, d, k)  # a place may have several tags
                k = k * width + tags[at]
            n = np.bincount(k, p["n"][at], last * width)
            has = np.flatnonzero(n)
            found.append(np.stack([np.full(len(has), i), has]))
            parts["n"].append(n[has])
            w = None if weight is None else weight(d)
            for name in names:
                x = p[name][at]
                parts[name].append(np.bincount(k, x if w is None else x * w, last * width)[has])
            if best and len(has):
                order = np.argsort(k.astype(np.int16), kind="stable")
                starts = np.searchsorted(k[order], has)
                for name, f in best.items():
                    parts[name].append(f.reduceat(p[name][at][order], starts))
        i, k = np.concatenate(found, axis=1) if found else np.zeros((2, 0), int)
        return {**{d: c[d][i] for d in dims}, "bin": k // width, "tag": labels[k % width], **{k: np.concatenate(v) if v else np.zeros(0) for k, v in parts.items()}}

    columns = [*(f"{d} double" for d in dims), "bin int", "tag long", *(f"{k} double" for k in ["n", *names, *best])]
    out = reduce_within(centers, points, dims, box, edges[-1], fn, ", ".join(columns), closed=closed == "right")
    zero = F.lit(0.0)
    out = out.select("*", zero.alias("n0"), *(zero.alias(f"{k}0") for k in names))
    own = points if asked is None else points.join(centers, dims, "left_semi")
    own = own.select(*dims, F.lit(0).alias("bin"), (F.col("tag") if tagged else F.lit(0).cast("long")).alias("tag"), zero.alias("n"), *(zero.alias(k) for k in names),
                     *(F.lit(none).alias(k) for k, (_, _, none) in far.items()), F.col("n").cast("double").alias("n0"), *(F.col(k).alias(f"{k}0") for k in names))
    both = out.unionByName(own).groupBy(*dims, "bin", "tag")
    infinite = lambda k, f, none: F.nullif(f(k), F.lit(none)).alias(k)
    return both.agg(*(F.sum(k).cast("long").alias(k) for k in ("n", "n0")), *(F.sum(k).alias(k) for s in ("", "0") for k in [f"{x}{s}" for x in names]), *(infinite(k, f, none) for k, (f, _, none) in far.items()))


def others(value: str, own: Column | None = None) -> Column:
    """A sum of around() over all rows of a bin but the row itself, whose own value is `own` (None: it counts as 1, for n)."""
    rest = F.col(f"{value}0") - (F.lit(1) if own is None else F.coalesce(own, F.lit(0.0)))
    return F.col(value) + F.when(F.col("n0") > 1, rest).otherwise(0)


def ranks_within(rows: DataFrame, dims: list[str], box: float, radius: float, value: str) -> DataFrame:
    """For each place of `rows`: order statistics of the values within `radius`, those at the place included.

    Returns (dims, n, far, own, n_own, mid, lo1, lo2, hi1, hi2, m0, m1, m2): how many values there are; their sums at
    other places and at this one; how many are at this one; the median; the two least and the two greatest; and the
    three values around the middle that decide the median of all but one of them.  Null values do not count.
    All points in reach of a cell come to one task, as 40 bytes each.
    """
    rows, dims = placed(rows, dims, box).withColumn("v", F.col(value).cast("double")), list(dims)
    points = rows.where("v is not null").groupBy(*dims, "v").agg(F.count(F.lit(1)).alias("m"))
    names = ["n", "far", "own", "n_own", "mid", "lo1", "lo2", "hi1", "hi2", "m0", "m1", "m2"]

    def fn(c, p, near, members):
        single, out, seen = bool((p["m"] == 1).all()), [], []
        for i in range(len(c[dims[0]])):
            at, d = near(i)
            (there,), (here,) = members(at[d > 0]), members(at[d == 0])
            r = np.concatenate([there, here])
            v, m = p["v"][r], p["m"][r]
            n = int(m.sum())
            if not n:
                continue
            low = max((n - 2) // 2, 0)
            want = np.clip([0, 1, n - 1, n - 2, low, low + 1, low + 2, (n - 1) // 2, n // 2], 0, n - 1)
            if single:
                s = np.partition(v, np.unique(want))[want]
            else:
                order = np.argsort(v)
                s = v[order][np.searchsorted(np.cumsum(m[order]), want, "right")]
            k = len(there)
            out.append((n, (v[:k] * m[:k]).sum(), (v[k:] * m[k:]).sum(), m[k:].sum(), (s[7] + s[8]) / 2, *s[:7]))
            seen.append(i)
        cols = np.array(out, float).reshape(-1, len(names)).T
        return {**{d: c[d][seen] for d in dims}, **dict(zip(names, cols))}

    return reduce_within(rows.select(*dims).distinct(), points, dims, box, radius, fn, ", ".join(f"{k} double" for k in [*dims, *names]), crowd=(20_000, None))


def counts_between(centers: DataFrame, points: DataFrame, dims: list[str], box: float, radius: float, low: str, high: str, value: str) -> DataFrame:
    """(dims, low, high, n): how many values of points within `radius` are above `low` and below `high` of a center, itself included."""
    dims = list(dims)
    centers = placed(centers, dims, box).select(*dims, F.col(low).cast("double").alias("low"), F.col(high).cast("double").alias("high")).where("low < high").distinct()
    points = placed(points, dims, box).groupBy(*dims, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("m")).where("v is not null")

    def fn(c, p, near, members):
        values, rank = np.unique(p["v"], return_inverse=True)  # ranks of 32 bits, so that an interval is one comparison
        rank, m, single = rank.astype(np.uint32), p["m"], bool((p["m"] == 1).all())
        first, last = np.searchsorted(values, c["low"], "right"), np.searchsorted(values, c["high"], "left")
        order = np.lexsort([c[d] for d in dims])
        n, place, r, k = np.zeros(len(order), np.int64), None, None, None
        for i in order:
            at = tuple(c[d][i] for d in dims)
            if at != place:
                (r,), place = members(near(i)[0]), at
                k = rank[r]
            if last[i] > first[i]:
                inside = k - np.uint32(first[i]) < np.uint32(last[i] - first[i])
                n[i] = np.count_nonzero(inside) if single else m[r[inside]].sum()
        return {**{d: c[d] for d in dims}, "low": c["low"], "high": c["high"], "n": n}

    out = reduce_within(centers, points, dims, box, radius, fn, ", ".join([*(f"{d} double" for d in dims), "low double", "high double", "n long"]))
    return out.groupBy(*dims, "low", "high").agg(F.sum("n").alias("n"))


def pairs_in_bins(a: DataFrame, b: DataFrame, dims: list[str], box: float, edges: list[float], tags: tuple[str, str] | None = None, weights: tuple[str, str] | None = None) -> DataFrame:
    """(bin, tag_a, tag_b, n, dd): pairs of rows of a and b in bins (edge, next edge] (distance 0 in the first, from edge 0), and the sums of their weights' products.

    Tags are strings here, null without `tags`; pairs of a row with itself count.
    """
    dims, bins, last = list(dims), bin_of(edges, "right"), len(edges) - 1

    def side(df: DataFrame, k: int) -> DataFrame:
        w = F.coalesce(F.col(weights[k]).cast("double"), F.lit(0.0)) if weights else F.lit(1.0)
        tag = F.col(tags[k]).cast("string") if tags else F.lit("")
        return placed(df, dims, box).groupBy(*dims, tag.alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"))

    def fn(c, p, near, members):
        import pandas as pd

        (ta, la), (tb, lb) = (pd.factorize(x["tag"], use_na_sentinel=False) for x in (c, p))
        n, dd = np.zeros((len(la), len(lb) * last)), np.zeros((len(la), len(lb) * last))
        for i in range(len(ta)):
            at, d = near(i)
            k = bins(d)
            keep = (k >= 0) & (k < last)
            at, k = members(at[keep], k[keep])
            k = tb[at] * last + k
            n[ta[i]] += c["n"][i] * np.bincount(k, p["n"][at], len(lb) * last)
            if weights:
                dd[ta[i]] += c["w"][i] * np.bincount(k, p["w"][at], len(lb) * last)
        i, k = np.nonzero(n)
        text = lambda labels, at: [None if x is None or x != x else x for x in np.asarray(labels, object)[at]]
        return {"bin": k % last, "tag_a": text(la, i), "tag_b": text(lb, k // last), "n": n[i, k], "dd": (dd if weights else n)[i, k]}

    out = reduce_within(side(a, 0), side(b, 1), dims, box, edges[-1], fn, "bin int, tag_a string, tag_b string, n double, dd double")
    return out.groupBy("bin", "tag_a", "tag_b").agg(F.sum("n").alias("n"), F.sum("dd").alias("dd"))
