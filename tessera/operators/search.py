"""Nearest neighbours over a vector column: exact, and by an index of lists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructField, StructType

from ..errors import InvalidError
from ..functions import vector
from . import nearest

METRICS = {"l2": vector.l2, "inner": vector.inner, "cosine": vector.cosine}


def knn(base: DataFrame, query: list[float], k: int, key: str = "vec_id", column: str = "embedding", metric: str = "l2") -> DataFrame:
    """(key, distance) of the k nearest; ties to the smaller key; NULL vectors are skipped.  Plans to a top-k in each task."""
    if metric not in METRICS:
        raise InvalidError(f"no metric {metric!r}")
    q = F.array(*[F.lit(float(x)).cast("float") for x in query])
    out = base.where(F.col(column).isNotNull()).select(key, METRICS[metric](F.col(column), q).alias("distance"))
    return out.orderBy("distance", key).limit(k)


def _best(near: DataFrame, k: int, key: str, part: list[str]) -> DataFrame:
    w = Window.partitionBy(*part).orderBy("distance", key)
    return near.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def _doubles(df: DataFrame, column: str) -> Column:
    """The vector column; whole numbers and decimals as doubles."""
    kind = df.schema[column].dataType
    return F.col(column) if getattr(kind, "elementType", None) in (FloatType(), DoubleType()) else F.col(column).cast("array<double>")


def _by_blocks(base: DataFrame, queries: DataFrame, k: int, metric: str, blocks: int, block: int) -> DataFrame:
    """(query, key, distance): the k nearest of ``base`` (key, v, lists) of each of ``queries`` (query, v, lists); where lists aren't NULL, only rows whose list the query names.

    Queries are dealt into blocks of about ``block``, rows into ``blocks``, and each pair of these is a cell, which is one task: it
    holds its queries while its rows stream past, and keeps the k best for each.  Rows are sent once for each block of queries,
    queries once for each block of rows, and no row is made for a pair until the nearest of a cell are known.
    """
    if metric not in METRICS:
        raise InvalidError(f"no metric {metric!r}")
    by_list = "lists" in base.columns
    if not by_list:
        base, queries = (x.withColumn("lists", F.lit(None).cast("array<int>")) for x in (base, queries))
    many = max(1, -(-queries.count() // block))
    deal = lambda n, *of: F.pmod(F.xxhash64(*of), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    no = lambda df, name: F.lit(None).cast(df.schema[name].dataType).alias(name)
    q = queries.select(each(blocks).alias("_b"), "query", "v", "lists").select((F.col("_b") * many + deal(many, "query", "v")).alias("_cell"), F.lit(0).alias("_side"), "query", no(base, "key"), "v", "lists")
    b = base.select(each(many).alias("_q"), "key", "v", "lists").select((deal(blocks, "key", "v") * many + F.col("_q")).alias("_cell"), F.lit(1).alias("_side"), no(queries, "query"), "key", "v", "lists")
    rows = q.unionByName(b).repartitionById(blocks * many, "_cell").sortWithinPartitions("_cell", "_side")
    out = StructType([StructField("query", queries.schema["query"].dataType), StructField("key", base.schema["key"].dataType), StructField("distance", DoubleType())])
    return rows.mapInArrow(nearest.scan(k, metric, by_list), out)


def knn_batch(base: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", column: str = "embedding", metric: str = "l2", blocks: int = 32, block: int = 8192) -> DataFrame:
    """(query key, key, distance): the k nearest of each of a stated set of queries, against all rows; ties to the smaller key, NULL vectors are skipped.

    The job is rows times queries by nature.  A matrix product finds the pairs that may count, with a bound for its
    rounding; only those get the distance, as ``functions.vector`` computes it.  See ``_by_blocks`` for ``blocks`` and ``block``.
    """
    b = base.where(F.col(column).isNotNull()).select(F.col(key).alias("key"), _doubles(base, column).alias("v"))
    q = queries.where(F.col(column).isNotNull()).select(F.col(key).alias("query"), _doubles(queries, column).alias("v"))
    return _best(_by_blocks(b, q, k, metric, blocks, block).withColumnRenamed("key", key), k, key, ["query"])


class VectorIndex:
    """An index for approximate nearest neighbours: vectors are listed under their nearest centroid, a search looks into a few lists.

    The centroids come from ``rounds`` of k-means over a sample of about ``sample`` rows, a bound that is this
    parameter; every row is listed, under its ``copies`` nearest centroids.  With ``probes`` as many as there are lists the search is exact.
    """

    def __init__(self, base: DataFrame, lists: int = 64, sample: int = 20_000, rounds: int = 8, copies: int = 1, key: str = "vec_id", column: str = "embedding", seed: int = 5):
        self.key, self.column, self.copies = key, column, copies
        rows = base.where(F.col(column).isNotNull()).select(key, column)
        n = rows.count()
        part = rows.sample(False, min(1.0, sample / max(1, n)), seed).select(column).toArrow()
        x = np.array(part.column(0).to_pylist(), np.float64)
        self.centroids = self._fit(x, min(lists, max(1, len(x))), rounds, seed)
        self.table = rows.withColumn("list", F.explode(self._nearest(_doubles(rows, column), copies))) if len(x) else rows.withColumn("list", F.lit(0))

    @staticmethod
    def _fit(x: np.ndarray, lists: int, rounds: int, seed: int) -> np.ndarray:
        if not len(x):
            return x
        c = x[np.random.default_rng(seed).choice(len(x), lists, replace=False)]
        for _ in range(rounds):
            near = ((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)).argmin(1)
            c = np.stack([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(lists)])
        return c

    def _nearest(self, v: Column, n: int) -> Column:
        """Numbers of the n nearest centroids."""
        return F.arrow_udf(nearest.lists_of(self.centroids, n), "array<int>")(v)

    def search(self, queries: DataFrame, k: int, probes: int = 8, metric: str = "l2", blocks: int = 32, block: int = 8192) -> DataFrame:
        """(query, key, distance): the k nearest that the ``probes`` nearest lists hold, for each query; in cells as ``knn_batch``, so a long list is no task of its own."""
        q = queries.where(F.col(self.column).isNotNull()).select(F.col(self.key).alias("query"), _doubles(queries, self.column).alias("v"))
        if not len(self.centroids):
            return q.join(self.table, F.lit(False)).select("query", self.key, F.lit(0.0).alias("distance"))
        table = self.table.select(F.col(self.key).alias("key"), _doubles(self.table, self.column).alias("v"), F.array("list").alias("lists"))
        near = _by_blocks(table.distinct() if self.copies > 1 else table, q.withColumn("lists", self._nearest(F.col("v"), probes)), k, metric, blocks, block).withColumnRenamed("key", self.key)
        return _best(near.distinct() if self.copies > 1 else near, k, self.key, ["query"])
