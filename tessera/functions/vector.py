"""Distances of ``array<float>`` columns, by higher-order functions; vectors of unequal length are an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _same_size(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("vectors of unequal length")).cast("double"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + x)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2(a: Column, b: Column) -> Column:
    return _same_size(a, b, F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))))


def inner(a: Column, b: Column) -> Column:
    """Negated, so that less is nearer."""
    return _same_size(a, b, -_dot(a, b))


def cosine(a: Column, b: Column) -> Column:
    return _same_size(a, b, 1 - _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)) + 1e-12))
