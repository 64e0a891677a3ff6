"""Vector columns: everything stays in the JVM, on ARRAY<DOUBLE|FLOAT>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x
    )


def total(v: Column) -> Column:
    return F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row; a plain expression used inside a lambda
    would be evaluated again for every element."""
    return F.transform(F.array(value), body)[0]


def mean(v: Column) -> Column:
    return let(v, lambda u: F.when(F.size(u) > 0, total(u) / F.size(u)))


def l2_normalise(v: Column, centre: bool = False) -> Column:
    """Unit vector; a zero vector passes through. ``centre`` subtracts the mean first."""
    v = as_double(v)
    if centre:
        v = let(v, lambda u: let(mean(u), lambda m: F.transform(u, lambda x: x - m)))
    return let(v, lambda u: let(F.sqrt(dot(u, u)), lambda n: F.when(n > 0, F.transform(u, lambda x: x / n)).otherwise(u)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - dot of unit vectors, held to [0, 2]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1.0 - dot(a, b)))


def mean_abs_diff(a: Column, b: Column) -> Column:
    return mean(F.zip_with(as_double(a), as_double(b), lambda x, y: F.abs(x - y)))


def normalise_cells(cells: Column) -> Column:
    return F.transform(cells, lambda c: l2_normalise(c))


def pool_cells(cells: Column) -> Column:
    """Mean over cells per dimension, then unit length."""
    def pooled(c: Column) -> Column:
        zero = F.transform(as_double(c[0]), lambda x: F.lit(0.0))
        summed = F.aggregate(c, zero, lambda s, x: F.zip_with(s, as_double(x), lambda p, q: p + q))
        return let(F.size(c), lambda n: F.transform(summed, lambda x: x / n))

    return l2_normalise(let(cells, pooled))


def top_k_mean(v: Column, k: int) -> Column:
    top = F.slice(F.sort_array(as_double(v), asc=False), 1, k)
    return mean(top)


def half_life_weight(dt: Column, half_life: float) -> Column:
    if half_life <= 0:
        return F.lit(1.0)
    return 1.0 - F.pow(F.lit(0.5), dt / F.lit(half_life))
