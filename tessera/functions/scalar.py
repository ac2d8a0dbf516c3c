"""Scalar functions by name, each an expression of built-ins that stays inside code generation.

NULL follows SQL, division and modulus by zero give NULL, ``length`` counts bytes, ``concat`` skips NULLs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import NotSupportedError
from . import vector


def _if_then(*args: Column) -> Column:
    pairs, other = args[:-1], args[-1]
    out = F.when(pairs[0], pairs[1])
    for cond, value in zip(pairs[2::2], pairs[3::2], strict=True):
        out = out.when(cond, value)
    return out.otherwise(other)


def _like(s: Column, pattern: str) -> Column:
    """% and _ only: a backslash stands for itself."""
    return s.like(pattern.replace("\\", "\\\\"))


def _substring(s: Column, start, length=None) -> Column:
    """1-based; a start below 1 counts as 1."""
    start = F.greatest(start if isinstance(start, Column) else F.lit(start), F.lit(1))
    return F.substr(s, start) if length is None else F.substr(s, start, length if isinstance(length, Column) else F.lit(length))


#: Name to builder.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "equal": lambda a, b: a == b,
    "not_equal": lambda a, b: a != b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "is_not_distinct_from": lambda a, b: a.eqNullSafe(b),
    "and": lambda *c: reduce(and_, c),
    "or": lambda *c: reduce(or_, c),
    "not": lambda c: ~c,
    "is_null": lambda c: c.isNull(),
    "is_not_null": lambda c: c.isNotNull(),
    "between": lambda c, a, b: c.between(a, b),
    "in": lambda c, *v: c.isin(*v),
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": lambda a, b: F.try_divide(a.cast("double"), b.cast("double")),
    "modulus": lambda a, b: F.try_mod(a, b),
    "date_add": lambda d, n: F.date_add(d, n),
    "date_sub": lambda d, n: F.date_sub(d, n),
    "date_diff": lambda a, b: F.datediff(a, b).cast("long"),
    "negate": lambda c: -c,
    "abs": F.abs,
    "round": F.round,
    "floor": lambda c: F.floor(c).cast("double"),
    "ceil": lambda c: F.ceil(c).cast("double"),
    "coalesce": F.coalesce,
    "if_then": _if_then,
    "cast": lambda c, kind: c.try_cast(kind),
    "hash": F.xxhash64,
    "like": _like,
    "starts_with": lambda s, x: s.startswith(x),
    "ends_with": lambda s, x: s.endswith(x),
    "contains": lambda s, x: s.contains(x),
    "substring": _substring,
    "length": lambda s: F.octet_length(s).cast("long"),
    "lower": F.lower,
    "upper": F.upper,
    "trim": F.trim,
    "ltrim": F.ltrim,
    "rtrim": F.rtrim,
    "concat": lambda *c: F.concat_ws("", *[x.cast("string") for x in c]),
    "regexp_match": lambda s, p: F.regexp_like(s, F.lit(p)),
    "regexp_replace": lambda s, p, r: F.regexp_replace(s, p, r),
    "split_part": lambda s, d, n: F.split_part(s, F.lit(d), F.lit(n)),
    "levenshtein": lambda a, b: F.levenshtein(a, b).cast("long"),
    "year": lambda d: F.year(d).cast("long"),
    "month": lambda d: F.month(d).cast("long"),
    "extract": lambda part, d: F.date_part(F.lit(part), d).cast("long"),
    "date_trunc": lambda part, d: F.date_trunc(part, d),
    "strftime": lambda d, p: F.date_format(d, p),
    "strptime": lambda s, p: F.try_to_timestamp(s, F.lit(p)),
    "vector_distance": vector.l2,
    "vector_inner": vector.inner,
    "vector_cosine": vector.cosine,
}

ALIASES = {
    "eq": "equal", "neq": "not_equal", "lessthan": "lt", "le": "lte", "greaterthan": "gt", "ge": "gte", "sub": "subtract", "mul": "multiply",
    "div": "divide", "mod": "modulus", "char_length_bytes": "length", "substr": "substring", "case": "if_then", "isin": "in",
}


def call(name: str, *args) -> Column:
    """The function by that name or alias."""
    name = ALIASES.get(name, name)
    if name not in FUNCTIONS:
        raise NotSupportedError(f"no function {name!r}")
    return FUNCTIONS[name](*args)
