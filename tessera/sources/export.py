"""Results for other tools: Arrow, pandas, matrices, tensors and tab-separated text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..errors import InvalidError, NotSupportedError


def to_matrix(df: DataFrame) -> np.ndarray:
    """A 2-D array of the numeric columns (an array column gives its elements); NULLs and strings are refused."""
    table = df.toArrow()
    parts = []
    for name, col in zip(table.column_names, table.columns, strict=True):
        if col.null_count:
            raise InvalidError(f"{name} has NULLs")
        if pa.types.is_list(col.type):
            rows = col.to_pylist()
            if len({len(r) for r in rows}) > 1:
                raise InvalidError(f"{name} has vectors of unequal length")
            parts.append(np.array(rows))
        elif pa.types.is_integer(col.type) or pa.types.is_floating(col.type) or pa.types.is_boolean(col.type):
            parts.append(col.to_numpy()[:, None])
        else:
            raise InvalidError(f"{name} is no number: {col.type}")
    return np.hstack(parts)


def from_arrow(spark: SparkSession, table: pa.Table) -> DataFrame:
    return spark.createDataFrame(table)


def from_matrix(spark: SparkSession, data, names: list[str] | None = None) -> DataFrame:
    """A column for each column of a 2-D array, tensor or other DLPack object; ``names``: c0, c1 and so on."""
    a = data if isinstance(data, np.ndarray) else np.from_dlpack(data)
    if a.ndim != 2:
        raise InvalidError(f"{a.ndim} dimensions aren't two")
    names = names or [f"c{i}" for i in range(a.shape[1])]
    return spark.createDataFrame(pa.table([pa.array(np.ascontiguousarray(x)) for x in a.T], names=names))


def to_torch(df: DataFrame):
    try:
        import torch
    except ImportError as e:
        raise NotSupportedError("torch isn't installed") from e
    return torch.from_dlpack(to_matrix(df))


def to_tsv(df: DataFrame, max_rows: int = 1000) -> str:
    """At most so many rows as text with a header; NULL is spelled out."""
    rows = df.limit(max_rows).collect()
    text = lambda v: "NULL" if v is None else str(v)
    return "".join("\t".join(r) + "\n" for r in [df.columns, *[[text(v) for v in row] for row in rows]])
