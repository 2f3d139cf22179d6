"""Algebra of sorted integer lists, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def select(xs: Column, index: Column | int) -> Column:
    """The element at a 0-based index; null outside."""
    return F.get(xs, index if isinstance(index, Column) else F.lit(index))


def lower_bound(xs: Column, key: Column | int) -> Column:
    """Position and value of the first element not below ``key``; the length and null where there is none."""
    key = key if isinstance(key, Column) else F.lit(key)
    at = F.size(F.filter(xs, lambda x: x < key)).cast("long")
    return F.struct(at.alias("position"), F.get(xs, at.cast("int")).alias("value"))


def position(xs: Column, key: Column | int) -> Column:
    """0-based position of the first element equal to ``key``; -1 where there is none."""
    return F.coalesce(F.array_position(xs, key).cast("long") - 1, F.lit(-1).cast("long"))


def insert(xs: Column, key: Column | int) -> Column:
    """The sorted list with ``key`` added; duplicates stay."""
    return F.array_sort(F.array_append(xs, key if isinstance(key, Column) else F.lit(key).cast("long")))


def delta(xs: Column, distance: int = 1) -> Column:
    """Differences to the element ``distance`` places before; the first elements stay."""
    return F.transform(xs, lambda x, i: F.when(i < distance, x).otherwise(x - F.get(xs, F.greatest(i - distance, F.lit(0)))))


def undelta(ds: Column, distance: int = 1) -> Column:
    """The list whose ``delta`` this is."""
    empty = F.array().cast("array<bigint>")
    return F.aggregate(ds, empty, lambda done, d: F.array_append(done, d + F.when(F.size(done) >= distance, F.get(done, F.greatest(F.size(done) - distance, F.lit(0)))).otherwise(F.lit(0).cast("long"))))


def intersect(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def complement(xs: Column, low: int, high: int) -> Column:
    """The integers of [low, high] that are not in the list."""
    return F.array_except(F.sequence(F.lit(low).cast("long"), F.lit(high).cast("long")), xs)


def frame_size(xs: Column) -> Column:
    """Bytes of a frame-of-reference list: count, minimum, width, then packed offsets; an empty list takes none."""
    low, high = F.array_min(xs), F.array_max(xs)
    width = F.when(high == low, 0).otherwise(F.char_length(F.conv((high - low).cast("string"), 10, 2)))
    return F.when(F.size(xs) == 0, 0).otherwise(4 + 5 + F.ceil(F.size(xs) * width / 8)).cast("long")
