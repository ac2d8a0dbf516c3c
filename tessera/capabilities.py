"""What the engine can do, by key: native (a Spark built-in), composed (built from built-ins) or unsupported."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .functions.aggregates import AGGREGATES, WINDOWS
from .functions.scalar import FUNCTIONS
from .operators.relational import JOINS

# The names under which parts of plans are asked for.
RELATIONS = ("read", "external", "filter", "project", "join", "aggregate", "sort", "limit", "window", "exchange")
#: Type to Spark's type that holds all its values, or None.
TYPES = {
    "bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)",
    "float32": "float", "float64": "double", "decimal64": "decimal(18,2)", "date32": "date", "timestamp": "timestamp", "string": "string", "binary": "binary", "fixed_vector": "array<float>", "null": None,
}
COMPOSED = {"fn:vector_distance", "fn:vector_inner", "fn:vector_cosine", "fn:if_then", "fn:concat", "fn:substring", "fn:like", "agg:string_agg", "agg:avg_distinct", *(f"type:{x}" for x in ("uint8", "uint16", "uint32", "uint64", "fixed_vector"))}


def capabilities() -> dict[str, str]:
    keys = [f"rel:{x}" for x in RELATIONS] + [f"join:{x}" for x in JOINS] + [f"fn:{x}" for x in FUNCTIONS] + [f"agg:{x}" for x in AGGREGATES] + [f"win:{x}" for x in WINDOWS]
    out = {k: "native" for k in keys} | {f"type:{x}": "native" if kind else "unsupported" for x, kind in TYPES.items()}
    return {k: "composed" if k in COMPOSED else v for k, v in out.items()}


def gaps(keys, known: dict[str, str] | None = None) -> dict[str, str]:
    """Key to reason for all that can't be run."""
    known = capabilities() if known is None else known
    return {k: "unknown name" if k not in known else "no type of Spark's holds it" for k in keys if known.get(k, "unsupported") == "unsupported"}


def save(path: str) -> None:
    """The listing as lines of key, tab, support."""
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(f"{k}\t{v}\n" for k, v in sorted(capabilities().items()))


def load(path: str) -> dict[str, str]:
    with open(path, encoding="utf-8") as f:
        return dict(line.rstrip("\n").split("\t") for line in f if line.strip())


def level(keys) -> str:
    """The worst level of all parts; unknown keys are unsupported."""
    known = capabilities()
    order = ["native", "composed", "unsupported"]
    return order[max([order.index(known.get(k, "unsupported")) for k in keys], default=0)]


def listing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(capabilities().items()), "key string, support string")


if __name__ == "__main__":
    for k, v in sorted(capabilities().items()):
        print(f"{k}\t{v}")
