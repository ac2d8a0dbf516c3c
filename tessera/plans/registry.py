"""All queries by name, and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import clicks, operators, tpch

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


_NAMES = re.compile(r"\b(from|join)(\s+)(" + "|".join(TABLES) + r")\b", re.IGNORECASE)


def sql_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """SQL over the Parquet tables of a folder; views of the user's with the same names stay as they are."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = sorted({m[3] for m in _NAMES.finditer(text)})
        tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in used}
        return spark.sql(_NAMES.sub(lambda m: f"{m[1]}{m[2]}{{{m[3]}}}", text), **tables)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {k: sql_query(v) for k, v in tpch.SQL.items()}
    out |= {k: sql_query(clicks.text(k, 0)) for k in clicks.SQL}
    return out | operators.QUERIES


def oracle_sql() -> dict[str, str]:
    return dict(tpch.SQL) | {k: clicks.text(k, 1) for k in clicks.SQL} | operators.ORACLES
