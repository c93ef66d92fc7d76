"""Array-valued feature columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(part: Column, whole: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(whole != 0, part / whole).otherwise(F.lit(0.0))


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed a single time per row.

    An expression named inside a lambda is evaluated for every element; bound to
    a lambda variable it is evaluated once.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def doubles(arr: Column | str) -> Column:
    arr = F.col(arr) if isinstance(arr, str) else arr
    return arr.cast("array<double>")


def standardise(arr: Column, mean: Column, std: Column) -> Column:
    centred = F.zip_with(arr, mean, lambda x, m: x - m)
    return F.zip_with(centred, std, lambda x, s: x / s)


def unstandardise(arr: Column, mean: Column, std: Column) -> Column:
    scaled = F.zip_with(arr, std, lambda x, s: x * s)
    return F.zip_with(scaled, mean, lambda x, m: x + m)


def element_sums(vector: str, dim: int, weight: Column | None = None) -> list[Column]:
    """One ``sum`` per coordinate: plain aggregates, combined before the shuffle."""
    w = F.lit(1.0) if weight is None else weight
    return [F.sum(w * F.col(vector)[i]).alias(f"_s{i}") for i in range(dim)]


def gathered(dim: int, divisor: Column | None = None) -> Column:
    """The coordinates of :func:`element_sums` as one array, divided if asked."""
    parts = [F.col(f"_s{i}") for i in range(dim)]
    if divisor is not None:
        parts = [p / divisor for p in parts]
    return F.array(*parts)
