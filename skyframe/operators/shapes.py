"""Shapes and centers of objects, found by iteration.

An object of up to `small` rows is fitted as one group, in memory.  Larger ones, however large, are fitted all at once
in rounds: a state of a few numbers for each object, one pass that adds up what its next state needs, and objects
drop out as they settle.  Both take the same steps.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .sizes import by_size, sender

SMALL = 200_000
_PAIRS = [(0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)]


def in_rounds(rows: DataFrame, key: str, state: DataFrame, sums: dict[str, Column], step: Callable[[pd.DataFrame], pd.DataFrame], rounds: int) -> DataFrame:
    """Steps all objects together until none is `open`.

    `state` has a row for each object with a boolean `open`; `sums` are aggregates over the object's rows joined with
    its state (null where no row counts); `step` turns a frame of open objects with their sums into their new states.
    """
    state = cut(state)
    send = sender(state)
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema)

    def run(batches):
        for pdf in batches:
            yield step(pdf)[state_columns]

    state_columns = state.columns
    for _ in range(rounds):
        going = state.where("open")
        if going.isEmpty():
            break
        added = rows.join(send(going), key).groupBy(key).agg(*(c.alias(n) for n, c in sums.items()))
        moved = going.join(added, key, "left").mapInPandas(run, shape)
        state = cut(state.where("not open").unionByName(moved))
    return state


def _ellipsoid_step(q: float, s: float, axes: np.ndarray, count: float, tensor: np.ndarray, least: int, close: float) -> tuple[float, float, np.ndarray, bool]:
    """New axis ratios and axes (rows, longest first) from the mean tensor in the original frame; whether to go on."""
    if not count >= least:
        return q, s, axes, False
    value, vector = np.linalg.eigh(tensor)
    if not value[0] > 1e-12 * value[2]:
        return q, s, axes, False
    new_q, new_s = np.sqrt(value[1] / value[2]), np.sqrt(value[0] / value[2])
    moved = max(abs(new_q - q) / q, abs(new_s - s) / s)
    return new_q, new_s, vector[:, ::-1].T, moved > close


def ellipsoids(rows: DataFrame, key: str, pos: list[str], mass: str, inner: float, outer: float, least: int = 20, rounds: int = 100, close: float = 1e-2, small: int = SMALL) -> DataFrame:
    """Axis ratios q = b/a and s = c/a of the rows in a shell of deformed radius (inner, outer], found by iteration.

    It ends when neither ratio moves by more than `close`, or with what it has when fewer than `least` rows are in the
    shell or the tensor has no volume; an object without one full step has nulls.  `rows` counts the object's rows.
    As no deformed radius is below the plain one, rows beyond `outer` are left out first.
    """
    kind = rows.schema[key].dataType.simpleString()
    r2 = sum((F.col(p) * F.col(p) for p in pos[1:]), F.col(pos[0]) * F.col(pos[0]))
    near = rows.where(r2 <= outer**2 * (1 + 1e-12)).select(F.col(key).alias("_key"), *(F.col(p).cast("double").alias(f"_x{k}") for k, p in enumerate(pos)), F.col(mass).cast("double").alias("_m"))
    sizes, name, key = rows.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("rows")), key, "_key"
    few, many = by_size(near, key, small)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, m = pdf[["_x0", "_x1", "_x2"]].to_numpy(float), pdf["_m"].to_numpy(float)
        axes, q, s, going, steps = np.eye(3), 1.0, 1.0, True, 0
        while going and steps < rounds:
            y = x @ axes.T / np.array([1.0, q, s])
            d2 = (y * y).sum(1)
            take = (d2 > inner**2) & (d2 <= outer**2)
            w = m[take] / m[take].sum() if take.any() else m[take]
            q, s, axes, going = _ellipsoid_step(q, s, axes, take.sum(), (x[take] * w[:, None]).T @ x[take], least, close)
            steps += 1
        known = (q, s) != (1.0, 1.0)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "q": [q if known else None], "s": [s if known else None]})

    out = few.groupBy(key).applyInPandas(fit, f"{key} {kind}, q double, s double")
    if many is not None:
        turned = [sum((F.col(f"_a{i}{j}") * F.col(f"_x{j}") for j in (1, 2)), F.col(f"_a{i}0") * F.col("_x0")) for i in range(3)]
        turned = [turned[0], turned[1] / F.col("q"), turned[2] / F.col("s")]
        d2 = turned[0] * turned[0] + turned[1] * turned[1] + turned[2] * turned[2]
        inside = (d2 > inner**2) & (d2 <= outer**2)
        sums = {"_count": F.count_if(inside), "_mass": F.sum(F.when(inside, F.col("_m")))} | {f"_t{i}{j}": F.sum(F.when(inside, F.col("_m") * F.col(f"_x{i}") * F.col(f"_x{j}"))) for i, j in _PAIRS}

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.copy()
            for at in pdf.index:
                r, tensor = pdf.loc[at], np.zeros((3, 3))
                for i, j in _PAIRS:
                    tensor[i, j] = tensor[j, i] = r[f"_t{i}{j}"] / r["_mass"] if r["_count"] > 0 else 0.0
                q, s, axes, going = _ellipsoid_step(r["q"], r["s"], np.array([[r[f"_a{i}{j}"] for j in range(3)] for i in range(3)]), r["_count"], tensor, least, close)
                pdf.loc[at, ["q", "s", *(f"_a{i}{j}" for i in range(3) for j in range(3))]] = [q, s, *axes.ravel()]
                pdf.loc[at, "open"] = going
            return pdf

        start = many.select(key).distinct().withColumns({"q": F.lit(1.0), "s": F.lit(1.0), "open": F.lit(True), **{f"_a{i}{j}": F.lit(float(i == j)) for i in range(3) for j in range(3)}})
        found = in_rounds(many, key, start, sums, step, rounds)
        known = (F.col("q") != 1) | (F.col("s") != 1)
        out = out.unionByName(found.select(key, F.when(known, F.col("q")).alias("q"), F.when(known, F.col("s")).alias("s")))
    return sizes.join(out, key, "left").select(F.col(key).alias(name), "q", "s", "rows")


def principal_axes(tensors: DataFrame, key: str) -> DataFrame:
    """Eigenvalues of (ixx, iyy, izz, ixy, ixz, iyz) and the first axis, largest moment first, by Arrow batches."""

    def run(batches):
        for pdf in batches:
            m = np.zeros((len(pdf), 3, 3))
            for k, (i, j) in {"ixx": (0, 0), "iyy": (1, 1), "izz": (2, 2), "ixy": (0, 1), "ixz": (0, 2), "iyz": (1, 2)}.items():
                m[:, i, j] = m[:, j, i] = pdf[k].to_numpy(float)
            value, vector = np.linalg.eigh(m) if len(pdf) else (np.zeros((0, 3)), np.zeros((0, 3, 3)))
            axis = vector[:, :, 2] * np.where(vector[:, 2, 2] < 0, -1, 1)[:, None]
            yield pd.DataFrame({key: pdf[key], "e1": value[:, 2], "e2": value[:, 1], "e3": value[:, 0], "ax": axis[:, 0], "ay": axis[:, 1], "az": axis[:, 2]})

    return tensors.mapInPandas(run, f"{key} {tensors.schema[key].dataType.simpleString()}, e1 double, e2 double, e3 double, ax double, ay double, az double")


def kth_smallest(rows: DataFrame, key: str, value: str, weight: str, wanted: DataFrame, bins: int = 1024) -> DataFrame:
    """(key, cut, below) for `wanted` (key, k): the least value up to which the weights add up to k, and the weight below it.

    Exact, without sorting an object's rows: counts in `bins` steps between bounds that close in on the value, all
    objects at once; the bounds are values that occur, and it ends when they meet.
    """
    send = sender(wanted)
    bounds = rows.join(send(wanted), key).groupBy(key, "k").agg(F.min(value).alias("low"), F.max(value).alias("high"))
    state = cut(bounds.withColumn("below", F.lit(0).cast("long")))
    while not (going := state.where("low < high")).isEmpty():
        inside = rows.join(send(going), key).where(F.col(value).between(F.col("low"), F.col("high")))
        at = F.least(F.floor((F.col(value) - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))
        steps = inside.groupBy(key, "k", "below", at.alias("_at")).agg(F.sum(weight).alias("_w"), F.min(value).alias("_low"), F.max(value).alias("_high"))
        upto = Window.partitionBy(key).orderBy("_at")  # at most `bins` rows an object
        steps = steps.withColumn("_upto", F.col("below") + F.sum("_w").over(upto)).where(F.col("_upto") >= F.col("k"))
        first = steps.groupBy(key, "k").agg(F.min_by(F.struct(F.col("_low").alias("low"), F.col("_high").alias("high"), (F.col("_upto") - F.col("_w")).alias("below")), "_at").alias("_s"))
        state = cut(state.where("low = high").unionByName(first.select(key, "k", "_s.low", "_s.high", "_s.below")))
    return state.select(key, "k", F.col("low").alias("cut"), "below")


def _shrunk(rows: DataFrame, key: str, xyz: list[str], box: float, stop: float, drop: float, rounds: int) -> DataFrame:
    """shrinking_centers() of objects too large for one task."""
    rows = cut(rows.groupBy(key, *xyz).agg(F.count(F.lit(1)).alias("_w")))  # rows at one place stay together
    least = cut(rows.groupBy(key).agg(F.floor(F.sum("_w") * F.lit(stop)).alias("_least")))
    send, done = sender(least), None
    for k in range(rounds):
        center = rows.groupBy(key).agg(F.sum("_w").alias("_n"), *((F.sum(F.col("_w") * F.col(x)) / F.sum("_w")).alias(f"c{x}") for x in xyz)).join(least, key)
        center = cut(center.withColumn("k", F.floor(F.col("_n") * F.lit(1 - drop))))
        ends = (F.col("k") == 0) | (F.col("k") == F.col("_n")) | (F.col("_n") <= F.col("_least")) | F.lit(k == rounds - 1)
        settled = center.where(ends).select(key, *(f"c{x}" for x in xyz))
        done = settled if done is None else done.unionByName(settled)
        going = center.where(~ends).select(key, "k", *(f"c{x}" for x in xyz))
        if going.isEmpty():
            break
        gap = [F.abs(F.col(x) - F.col(f"c{x}")) for x in xyz]
        gap = [F.least(g, F.lit(box) - g) for g in gap] if box else gap
        d2 = sum((g * g for g in gap[1:]), gap[0] * gap[0])
        left = cut(rows.join(send(going.drop("k")), key).select(key, *xyz, "_w", d2.alias("_d")))
        kept, asked, tied = None, going.select(key, "k"), left
        for v in ["_d", *xyz]:  # what is equal in one is told apart by the next
            at = kth_smallest(tied, key, v, "_w", asked)
            tied = tied.join(send(at), key)
            closer = tied.where(F.col(v) < F.col("cut")).select(key, *xyz, "_w")
            kept = closer if kept is None else kept.unionByName(closer)
            tied = cut(tied.where(F.col(v) == F.col("cut")).withColumn("_k", F.col("k") - F.col("below")).drop("k", "cut", "below"))
            sizes = tied.groupBy(key, F.col("_k").alias("k")).agg(F.sum("_w").alias("_all"))
            asked = cut(sizes.where(F.col("_all") > F.col("k")).select(key, "k"))
            kept = kept.unionByName(tied.join(send(asked.select(key)), key, "left_anti").select(key, *xyz, "_w"))
            if asked.isEmpty():
                break
            tied = tied.drop("_k").join(send(asked.select(key)), key, "left_semi")
        else:  # one place: as many of its rows as are wanted
            kept = kept.unionByName(tied.join(asked, key).select(key, *xyz, F.col("k").alias("_w")))
        rows = cut(kept)
    return done


def shrinking_centers(rows: DataFrame, key: str, pos: list[str], box: float = 0.0, stop: float = 0.1, drop: float = 0.05, rounds: int = 100, small: int = SMALL) -> DataFrame:
    """Center of each object when the farthest `drop` are left out again and again until `stop` of the rows remain.

    Distances are periodic in `box` (0: open space); the center is the plain mean.  Rows equally far are left out in
    the order of their coordinates, last first.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[xyz].to_numpy(float)
        least = int(len(x) * stop)
        for _ in range(rounds):
            center = x.mean(0)
            kept = int(len(x) * (1 - drop))
            if kept in (0, len(x)) or len(x) <= least:
                break
            gap = np.abs(x - center)
            gap = np.minimum(gap, box - gap) if box else gap
            x = x[np.lexsort((*x.T[::-1], (gap ** 2).sum(1)))[:kept]]
        return pd.DataFrame({key: [pdf[key].iloc[0]], **{f"c{n}": [c] for n, c in zip(xyz, center)}})

    kind, xyz = rows.schema[key].dataType.simpleString(), [f"_x{k}" for k in range(len(pos))]
    rows, name, key = rows.select(F.col(key).alias("_key"), *(F.col(p).cast("double").alias(x) for p, x in zip(pos, xyz))), key, "_key"
    few, many = by_size(rows, key, small)
    out = few.groupBy(key).applyInPandas(run, f"{key} {kind}, " + ", ".join(f"c{x} double" for x in xyz))
    if many is not None:
        out = out.unionByName(_shrunk(many, key, xyz, box, stop, drop, rounds))
    return out.select(F.col(key).alias(name), *(F.col(f"c{x}").alias(p) for p, x in zip(pos, xyz)))


def power_spectra(grids: DataFrame, key: str, n: int, box: float) -> DataFrame:
    """Shell means of the power of gridded fields (key, ix, iy, iz, value), times 4 pi k^2; missing cells are 0.

    The transform goes axis by axis: lines of n cells along one axis are put together, transformed many at a time, and
    dealt anew along the next, so no task holds more than some lines of a grid.
    """
    rows = grids.groupBy(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c[1]}") for c in ("ix", "iy", "iz"))).agg(F.sum("value").cast("double").alias("_re")).withColumn("_im", F.lit(0.0))
    kind = rows.schema["_key"].dataType.simpleString()

    for axis, others in (("_z", ["_x", "_y"]), ("_y", ["_x", "_z"]), ("_x", ["_y", "_z"])):
        def transform(batches, others=others):
            for pdf in batches:
                field = np.zeros((len(pdf), n), complex)
                for i, (at, re, im) in enumerate(zip(pdf["at"], pdf["re"], pdf["im"])):
                    field[i, at] = re + 1j * im
                field = np.fft.fft(field, axis=1) / n
                yield pd.DataFrame({"_key": pdf["_key"], **{o: pdf[o] for o in others}, "re": list(field.real), "im": list(field.imag)})

        lines = rows.groupBy("_key", *others).agg(F.collect_list(F.struct(axis, "_re", "_im")).alias("_l"))  # at most n
        lines = lines.select("_key", *others, F.col(f"_l.{axis}").alias("at"), F.col("_l._re").alias("re"), F.col("_l._im").alias("im"))
        done = lines.mapInPandas(transform, f"_key {kind}, {others[0]} int, {others[1]} int, re array<double>, im array<double>")
        rows = done.select("_key", *others, F.posexplode(F.arrays_zip("re", "im")).alias(axis, "_v")).select("_key", "_x", "_y", "_z", F.col("_v.re").alias("_re"), F.col("_v.im").alias("_im"))
    wave = [F.when(F.col(c) < (n + 1) // 2, F.col(c)).otherwise(F.col(c) - n) for c in ("_x", "_y", "_z")]
    shell = F.rint(F.sqrt(sum((w * w for w in wave[1:]), wave[0] * wave[0]))).cast("int")
    means = rows.groupBy("_key", shell.alias("shell")).agg(F.avg(F.col("_re") * F.col("_re") + F.col("_im") * F.col("_im")).alias("_p")).where((F.col("shell") >= 1) & (F.col("shell") < n // 2))
    k = F.col("shell") * (2 * np.pi / box)
    return means.select(F.col("_key").alias(key), "shell", (F.col("_p") * (4 * np.pi) * k * k).alias("power"))


def cuboid_remap(rows: DataFrame, key: str, pos: list[str], lattice: list[list[int]], box: float = 1.0) -> DataFrame:
    """Periodic cube positions in a cuboid of the same volume, whose edges follow three integer lattice vectors."""
    u = np.array(lattice, float)
    if round(abs(np.linalg.det(u))) != 1:
        raise ValueError("lattice vectors must span one cell")
    e = np.zeros((3, 3))  # edges: the vectors made orthogonal one after another
    for i in range(3):
        e[i] = u[i] - sum((u[i] @ e[j]) / (e[j] @ e[j]) * e[j] for j in range(i))
    size = np.linalg.norm(e, axis=1)
    frame, reach = e / size[:, None], range(-4, 5)
    cube = np.array([[a, b, c] for a in (0, 1) for b in (0, 1) for c in (0, 1)]) @ frame.T
    moved = [(np.array([a, b, c]), cube + frame @ [a, b, c]) for a in reach for b in reach for c in reach]
    shifts = [s for s, at in moved if (at.max(0) >= -1e-9).all() and (at.min(0) <= size + 1e-9).all()]  # the images that can meet the cuboid

    def run(batches):
        for pdf in batches:
            x = pdf[pos].to_numpy(float) / box
            out, done = np.full_like(x, np.nan), np.zeros(len(x), bool)
            for s in shifts:
                left = np.flatnonzero(~done)
                if not len(left):
                    break
                y = (x[left] + s) @ frame.T
                hit = (y >= -1e-12).all(1) & (y < size - 1e-12).all(1)
                out[left[hit]], done[left[hit]] = y[hit], True
            yield pd.DataFrame({key: pdf[key], **{p: out[:, k] * box for k, p in enumerate(pos)}})

    return rows.select(key, *pos).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, " + ", ".join(f"{p} double" for p in pos))
