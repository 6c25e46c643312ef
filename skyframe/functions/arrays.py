"""Functions of array columns: spectra as arrays of optical depths, and small lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col


def sum_of(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def last_nonzero(a, missing: int = -1) -> Column:
    """Index (from 0) of the last element that is not zero."""
    a = col(a)
    found = F.array_position(F.transform(F.reverse(a), lambda x: x != 0), True)
    return F.when(found > 0, F.size(a) - found).otherwise(F.lit(missing)).cast("int")


def nearest_in(values: Sequence[float], x) -> Column:
    """Index (from 0) of the nearest value, the first of equals."""
    gaps = F.transform(F.array(*(F.lit(float(v)) for v in values)), lambda v: F.abs(v - col(x)))
    return (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")


def absorbed(tau) -> Column:
    return F.transform(col(tau), lambda t: 1 - F.exp(-t))


def equivalent_width(tau, step: float = 1.0) -> Column:
    """Trapezoid of 1 - exp(-tau) over equally spaced pixels."""
    e = absorbed(tau)
    return (sum_of(e) - (F.element_at(e, 1) + F.element_at(e, -1)) / 2) * step


def cumulative(a: Column) -> Column:
    """Running sums of an array."""
    return F.aggregate(a, F.array().cast("array<double>"), lambda s, x: F.array_append(s, F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0.0)) + x))


def crossing(cum: Column, level: Column) -> Column:
    """Fractional index at which a running sum reaches a level."""
    k = F.array_position(F.transform(cum, lambda c: c >= level), True)
    before = F.when(k > 1, F.try_element_at(cum, (k - 1).cast("int"))).otherwise(F.lit(0.0))
    return k - 2 + (level - before) / (F.try_element_at(cum, k.cast("int")) - before)


def v90(tau, step: float = 1.0) -> Column:
    """Width between the 5 % and 95 % points of the total optical depth; 0 without any."""
    cum = cumulative(col(tau))
    total = F.element_at(cum, -1)
    return F.when(total > 0, (crossing(cum, total * 0.95) - crossing(cum, total * 0.05)) * step).otherwise(F.lit(0.0))


def resampled(tau, every: int, most: float = 1 - 1e-16) -> Column:
    """Coarser pixels of `every` fine ones that keep the mean absorbed flux."""
    e, n = absorbed(tau), F.size(col(tau))
    mean = lambda k: sum_of(F.slice(e, k * every + 1, F.lit(every))) / every
    return F.transform(F.sequence(F.lit(0), F.floor(n / every).cast("int") - 1), lambda k: -F.log(1 - F.least(mean(k), F.lit(most))))


def window_around(a, center, half: int) -> Column:
    """Elements within `half` of a 0-based center, cut at the ends."""
    a, c = col(a), col(center)
    first = F.greatest(c - half, F.lit(0))
    return F.slice(a, (first + 1).cast("int"), (F.least(c + half, F.size(a) - 1) - first + 1).cast("int"))
