"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(src, dst) long edges to (node, root), root being the smallest node of the component.

    Each round rewires all edges with two aggregate-and-join steps (neighbour minima are combined before
    the shuffle; a hub with very many edges is split by adaptive skew joins), and the edge list is written
    to the shared folder, so the lineage stays short.  Self edges and edges with a null end are ignored;
    nodes without another edge don't appear.  Rounds grow with the logarithm of the component's size.
    """
    e = edges.where("src is not null and dst is not null and src <> dst")
    e = written(e.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    mark = _mark(e)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "large")
        discard(e)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        # the edge (u, m) itself is among the rows, as the one with v = m
        e, last = written(small.distinct(), "edges"), mark
        discard(large)
        mark = _mark(e)
        if mark == last:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
