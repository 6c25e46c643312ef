"""Closed-form columns: logarithms, periodic geometry, restrictions, bins, interpolation, bit fields, rotations."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


# --- logarithms -----------------------------------------------------------------------------------------------
def log_or_null(x) -> Column:
    """log10 of positive finite values, else null."""
    x = col(x)
    return F.when((x > 0) & ~F.isnan(x) & (x < F.lit(math.inf)), F.log10(x))


def log_or(x, zero: float = 1.0) -> Column:
    """log10 after zeros and negatives become `zero`."""
    x = col(x)
    return F.log10(F.when(x > 0, x).otherwise(F.lit(float(zero))))


# --- periodic geometry ------------------------------------------------------------------------------------------
def magnitude(*xs) -> Column:
    return F.sqrt(sum((col(x) * col(x) for x in xs[1:]), col(xs[0]) * col(xs[0])))


def wrapped(x, box: float) -> Column:
    """A position brought into [0, box)."""
    return F.pmod(col(x), F.lit(float(box)))


def min_image(d, box: float) -> Column:
    """A separation's nearest periodic image; a box of 0 is not periodic."""
    d = col(d)
    if not box:
        return d
    return F.when(d > box / 2, d - box).when(d < -box / 2, d + box).otherwise(d)


def separation(a: Sequence, b: Sequence, box: float, kind: str = "euclid") -> Column:
    """Periodic distance of two positions of any dimension: euclid, squared or chebyshev."""
    ds = [min_image(col(p) - col(q), box) for p, q in zip(a, b)]
    if kind == "chebyshev":
        return F.greatest(*map(F.abs, ds)) if len(ds) > 1 else F.abs(ds[0])
    squared = sum((d * d for d in ds[1:]), ds[0] * ds[0])
    return squared if kind == "squared" else F.sqrt(squared)


def radial_velocity(dpos: Sequence, dvel: Sequence, hubble: float = 0.0, least: float = 1e-16) -> Column:
    """Velocity along the separation, with the Hubble flow added."""
    r = F.greatest(magnitude(*dpos), F.lit(least))
    return sum((col(p) * col(v) for p, v in zip(dpos, dvel)), F.lit(0.0)) / r + F.lit(hubble) * magnitude(*dpos)


def cross(a: Sequence, b: Sequence) -> list[Column]:
    (ax, ay, az), (bx, by, bz) = map(col, a), map(col, b)
    return [ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx]


# --- restrictions and bins --------------------------------------------------------------------------------------
def restriction(rules: dict) -> Column:
    """{field: [op, value]}; `lt` keeps equal values (as catalogs define it), `slt` is strict, `between` half-open."""
    out = F.lit(True)
    for name, (op, *v) in rules.items():
        x = col(name)
        out = out & {"gt": lambda: x > v[0], "ge": lambda: x >= v[0], "lt": lambda: x <= v[0], "slt": lambda: x < v[0], "eq": lambda: x == v[0], "between": lambda: (x >= v[0]) & (x < v[1])}[op]()
    return out


def bin_index(x, low: float, high: float, bins: int, log: bool = False, closed: str = "left") -> Column:
    """Number of the equal bin of x from 0, or null outside.

    closed: "left" [a, b), "numpy" the same with the last bin closed, "right" (a, b].
    """
    x = F.log10(col(x)) if log else col(x)
    if log:
        low, high = math.log10(low), math.log10(high)
    scaled = (x - low) * bins / (high - low)
    if closed == "right":
        return F.when((x > low) & (x <= high), F.least(F.ceil(scaled) - 1, F.lit(bins - 1))).cast("int")
    k = F.least(F.floor(scaled), F.lit(bins - 1)).cast("int")
    return F.when((x >= low) & ((x <= high) if closed == "numpy" else (x < high)), k)


def edge_bin(x, edges: Sequence[float], closed: str = "left") -> Column:
    """Number of the bin between consecutive edges, or null outside; closed as in bin_index."""
    x, last = col(x), len(edges) - 2
    out = F.lit(None).cast("int")
    for k in range(last, -1, -1):
        a, b = edges[k], edges[k + 1]
        inside = (x > a) & (x <= b) if closed == "right" else (x >= a) & ((x <= b) if closed == "numpy" and k == last else (x < b))
        out = F.when(inside, F.lit(k)).otherwise(out)
    return out


# --- interpolation ----------------------------------------------------------------------------------------------
def between_rows(v0, v1, tau) -> Column:
    return col(v0) + (col(v1) - col(v0)) * col(tau)


def hermite(p0, p1, v0, v1, tau, dt) -> Column:
    """Cubic Hermite: positions and velocities at the ends of an interval of length dt, at its fraction tau."""
    t, dt = col(tau), col(dt)
    t2, t3 = t * t, t * t * t
    return (2 * t3 - 3 * t2 + 1) * col(p0) + (t3 - 2 * t2 + t) * dt * col(v0) + (3 * t2 - 2 * t3) * col(p1) + (t3 - t2) * dt * col(v1)


def on_grid(x, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Linear interpolation in a small table, clamped to its ends."""
    x = F.least(F.greatest(col(x), F.lit(float(xs[0]))), F.lit(float(xs[-1])))
    out = F.lit(float(ys[-1]))
    for k in range(len(xs) - 2, -1, -1):
        line = F.lit(float(ys[k])) + (x - float(xs[k])) * ((ys[k + 1] - ys[k]) / (xs[k + 1] - xs[k]))
        out = F.when(x <= float(xs[k + 1]), line).otherwise(out)
    return out


def on_grid_2d(x, y, xs: Sequence[float], ys: Sequence[float], table: Sequence[Sequence[float]]) -> Column:
    """Bilinear interpolation in table[i][j] at (xs[i], ys[j]) on equal grids, clamped to the edges."""
    def place(v, grid):
        u = (F.least(F.greatest(col(v), F.lit(float(grid[0]))), F.lit(float(grid[-1]))) - float(grid[0])) / float(grid[1] - grid[0])
        k = F.least(F.floor(u), F.lit(len(grid) - 2)).cast("int")
        return k, u - k
    (i, fx), (j, fy) = place(x, xs), place(y, ys)
    flat = F.array(*(F.lit(float(v)) for row in table for v in row))
    at = lambda a, b: flat[a * len(ys) + b]
    return (at(i, j) * (1 - fx) + at(i + 1, j) * fx) * (1 - fy) + (at(i, j + 1) * (1 - fx) + at(i + 1, j + 1) * fx) * fy


def polynomial2(z, c, coefficients: Sequence[Sequence[float]]) -> Column:
    """sum c[j][k] z^j color^k by Horner's rule."""
    z, c = col(z), col(c)
    out = F.lit(0.0)
    for row in reversed(coefficients):
        inner = F.lit(0.0)
        for a in reversed(row):
            inner = inner * c + float(a)
        out = out * z + inner
    return out


# --- bits, rotations --------------------------------------------------------------------------------------------
def bits(x, first: int, count: int) -> Column:
    """`count` bits of a long from bit `first` (0 is the lowest) on."""
    return F.shiftrightunsigned(col(x).cast("long"), first).bitwiseAND(F.lit((1 << count) - 1))


def rotated(pos: Sequence, matrix: Sequence[Sequence[float]], center: Sequence[float], box: float = 0.0, back: bool = True) -> list[Column]:
    """Positions turned about a center (nearest image first), moved back unless `back` is false."""
    ds = [min_image(col(p) - float(c), box) for p, c in zip(pos, center)]
    turned = [sum((ds[k] * float(row[k]) for k in range(1, 3)), ds[0] * float(row[0])) for row in matrix]
    return [t + float(c) for t, c in zip(turned, center)] if back else turned


def rotation_about(axis: str, degrees: float) -> list[list[float]]:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return {"x": [[1, 0, 0], [0, c, -s], [0, s, c]], "y": [[c, 0, s], [0, 1, 0], [-s, 0, c]], "z": [[c, -s, 0], [s, c, 0], [0, 0, 1]]}[axis]


def perspective(x, y, z, near: float, far: float, half_width: float) -> list[Column]:
    """Camera coordinates: x and y shrink with the distance z from the camera, depth runs from -1 at near to 1 at far."""
    z = col(z)
    return [col(x) * near / (half_width * z), col(y) * near / (half_width * z), (far + near) / (far - near) - (2 * far * near / (far - near)) / z]


def in_cone(x, y, z, near: float, far: float, tan_y: float, tan_z: float, y0: float = 0.0, z0: float = 0.0) -> Column:
    """Strictly between two distances along x and strictly inside the opening angles around (y0, z0)."""
    x, y, z = col(x), col(y), col(z)
    inside = lambda v, at, tan: (v > at - x * tan) & (v < at + x * tan)
    return (x > near) & (x < far) & inside(y, y0, tan_y) & inside(z, z0, tan_z)
