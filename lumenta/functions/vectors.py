"""Expressions on vectors held as rows (indices, values)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_map(indices: Column, values: Column) -> Column:
    return F.map_from_arrays(indices, values)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value found once a row: a lambda in body would else find it again for each of its elements."""
    return F.get(F.transform(F.array(value), body), 0)


def dense(indices: Column, values: Column, dim: int) -> Column:
    """The vector's dim values, 0 where it has none."""
    return once(as_map(indices, values), lambda m: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda t: F.coalesce(F.try_element_at(m, t).cast("double"), F.lit(0.0))))


def dot_dense(indices: Column, values: Column, other: Column) -> Column:
    """The inner product with a dense array, row by row; places beyond its end count as 0."""
    products = once(other, lambda o: F.zip_with(indices, values, lambda t, v: v.cast("double") * F.coalesce(F.get(o, t).cast("double"), F.lit(0.0))))
    return F.aggregate(products, F.lit(0.0), lambda a, x: a + x)


def dot_codes(indices: Column, codes: Column, other: Column) -> Column:
    """The same on integer codes, exact in 64 bits."""
    products = once(other, lambda o: F.zip_with(indices, codes, lambda t, v: v.cast("bigint") * F.coalesce(F.get(o, t).cast("bigint"), F.lit(0).cast("bigint"))))
    return F.aggregate(products, F.lit(0).cast("bigint"), lambda a, x: a + x)


def argmax(values: Column) -> Column:
    """The first place of the largest value of an array."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
