"""Aggregate and window functions by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..errors import NotSupportedError

AGGREGATES: dict[str, Callable[..., Column]] = {
    "sum": F.sum,
    "count": F.count,
    "count_star": lambda: F.count(F.lit(1)),
    "min": F.min,
    "max": F.max,
    "avg": lambda c: F.avg(c.cast("double")),
    "count_distinct": F.count_distinct,
    "sum_distinct": F.sum_distinct,
    "avg_distinct": lambda c: F.try_divide(F.sum_distinct(c.cast("double")), F.count_distinct(c)),
    "median": F.median,
    "quantile": lambda c, q: F.percentile(c, q),
    "string_agg": lambda c, sep=",": F.array_join(F.array_sort(F.collect_list(c)), sep),
    "approx_count_distinct": F.approx_count_distinct,
    "stddev": F.stddev_samp,
    "variance": F.var_samp,
}


def aggregate(name: str, *args) -> Column:
    if name not in AGGREGATES:
        raise NotSupportedError(f"no aggregate {name!r}")
    return AGGREGATES[name](*args)


def run_sum(value: Column, run: Column) -> Column:
    """Sum over rows that each stand for ``run`` equal rows."""
    return F.sum(value * run)


def run_count(value: Column, run: Column) -> Column:
    return F.sum(F.when(value.isNotNull(), run).otherwise(0))


_RANKING = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}
WINDOWS = (*_RANKING, "lag", "lead", "sum", "avg", "min", "max", "count")


def window(name: str, *args, partition: Sequence = (), order: Sequence[Column] = ()) -> Column:
    """With an order, aggregates run over ROWS from the partition's start to the row; without, over all of it."""
    if name not in WINDOWS:
        raise NotSupportedError(f"no window function {name!r}")
    w = Window.partitionBy(*partition)
    if order:
        w = w.orderBy(*order)
    if name in _RANKING:
        return _RANKING[name]().over(w)
    if name in ("lag", "lead"):
        return getattr(F, name)(*args).over(w)
    if order:
        w = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return aggregate(name if args or name != "count" else "count_star", *args).over(w)
