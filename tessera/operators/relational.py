"""Relational operators that need more than one DataFrame call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidError

#: Name to Spark's join type.
JOINS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}


def join(left: DataFrame, right: DataFrame, kind: str, left_keys: Sequence[str], right_keys: Sequence[str], null_safe: bool = False, residual: Column | None = None) -> DataFrame:
    """Equi-join by pairs of keys, further narrowed by ``residual``.  Spark and AQE choose broadcast, hash or merge by size."""
    if kind not in JOINS or len(left_keys) != len(right_keys):
        raise InvalidError(f"no join {kind!r} by {left_keys} and {right_keys}")
    if not left_keys and residual is None:
        if kind != "inner":
            raise InvalidError("a join without a condition is inner")
        return left.crossJoin(right)
    on = [left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b] for a, b in zip(left_keys, right_keys, strict=True)]
    return left.join(right, on + ([] if residual is None else [residual]), JOINS[kind])


def salted_join(large: DataFrame, small: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """Inner join on a skewed key: rows of the large side are dealt over salts, those of the other repeated for each.

    For plans where adaptive skew joins can't split a partition, such as below another shuffle on the key.
    """
    a = large.withColumn("_salt", F.pmod(F.xxhash64(*large.columns), F.lit(salts)).cast("int"))
    b = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return a.join(b, [key, "_salt"]).drop("_salt")


#: Steps into which ``inequality_join`` cuts the values of a key at most.
STEPS = 64


def inequality_join(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], value: Column, bound: Column, rows: int = 256, pairs: int = 1 << 24) -> DataFrame:
    """Inner join on equal keys where ``value``, a number or time of the left side, exceeds ``bound``, one of the right side; for keys that many rows share.

    Rows beyond the other side's extremes for their key go first.  The left rows of a key are then cut by value into steps of
    about ``rows``, 64 at most, and a right row meets only the steps that reach its bound: nearly all compared pairs are rows of the result.
    Steps and right rows are dealt over cells of about ``pairs`` pairs, and as many partitions are made as there are ``pairs`` of pairs to compare,
    so a task's work is bounded however large a key is.  Rows that are equal in all columns stay together.
    """
    n = len(left_keys)
    if not n or n != len(right_keys):
        raise InvalidError(f"no join by {left_keys} and {right_keys}")
    kinds = left.select(*left_keys).limit(0).union(right.select(*right_keys).limit(0)).dtypes  # the common types, so that both sides are dealt alike
    ks = [f"_k{i}" for i in range(n)]
    side = lambda df, keys, tag, v: df.select(*[F.col(f"`{x}`").alias(f"_{tag}{i}") for i, x in enumerate(df.columns)], *[F.col(f"`{x}`").cast(t).alias(k) for x, (_, t), k in zip(keys, kinds, ks, strict=True)], v.alias(f"_{tag}v"))
    hashed = lambda df, tag: F.xxhash64(f"_{tag}v", *[f"_{tag}{i}" for i, (_, t) in enumerate(df.dtypes) if "map<" not in t and "variant" not in t])
    a, b = side(left, left_keys, "a", value), side(right, right_keys, "b", bound)
    a = a.join(b.groupBy(*ks).agg(F.min("_bv").alias("_least")), ks).where("_av > _least").drop("_least")
    of_a = a.groupBy(*ks).agg(F.max("_av").alias("_top"), F.count("*").alias("_na"), F.percentile_approx("_av", [i / STEPS for i in range(1, STEPS)], 1000).alias("_cuts"))
    b = b.join(of_a.select(*ks, "_top"), ks).where("_bv < _top").drop("_top")
    both = of_a.drop("_top").join(b.groupBy(*ks).agg(F.count("*").alias("_nb")), ks)
    parts = max(1, -(-int(both.agg(F.sum(F.col("_na").cast("double") * F.col("_nb"))).first()[0] or 0) // pairs))
    both = both.withColumn("_steps", F.least(F.lit(STEPS), F.ceil(F.col("_na") / rows)).cast("int"))
    both = both.withColumn("_salts", F.ceil(F.col("_na") / (F.col("_steps") * 16 * rows)).cast("int"))
    both = both.withColumn("_chunks", F.ceil(F.col("_nb") * F.col("_na") / (F.col("_steps") * F.col("_salts")) / pairs).cast("int")).drop("_na", "_nb")
    step = lambda v: F.floor(F.size(F.filter("_cuts", lambda x: x < F.col(v))) * F.col("_steps") / STEPS).cast("int")  # noqa: E731  never falls as v grows
    upto = lambda first, n: F.explode(F.sequence(first, F.col(n) - 1))
    dealt, on = ["_steps", "_salts", "_chunks", "_cuts"], [*ks, "_step", "_salt", "_chunk"]
    a = a.join(both, ks).withColumns({"_step": step("_av"), "_salt": F.pmod(hashed(left, "a"), F.col("_salts")).cast("int")}).withColumn("_chunk", upto(F.lit(0), "_chunks")).drop(*dealt)
    b = b.join(both, ks).withColumns({"_from": step("_bv"), "_chunk": F.pmod(hashed(right, "b"), F.col("_chunks")).cast("int")})
    b = b.withColumn("_step", upto(F.col("_from"), "_steps")).withColumn("_salt", upto(F.lit(0), "_salts")).drop("_from", *dealt)
    out = a.repartition(parts, *on).join(b.repartition(parts, *on), on).where("_av > _bv")
    return out.select(*[F.col(f"_a{i}").alias(x) for i, x in enumerate(left.columns)], *[F.col(f"_b{i}").alias(x) for i, x in enumerate(right.columns)])


def sort(df: DataFrame, *keys: tuple[str | Column, bool], nulls_first: bool = False) -> DataFrame:
    """Keys with True for ascending; NULLs last both ways unless told otherwise."""
    out = []
    for k, up in keys:
        c = F.col(k) if isinstance(k, str) else k
        out.append((c.asc_nulls_first() if nulls_first else c.asc_nulls_last()) if up else (c.desc_nulls_first() if nulls_first else c.desc_nulls_last()))
    return df.orderBy(*out)


def limit(df: DataFrame, count: int | None = None, offset: int = 0) -> DataFrame:
    """Over a sort this plans to one TakeOrderedAndProject."""
    df = df.offset(offset) if offset else df
    return df if count is None else df.limit(count)


#: Bytes of a side that may be broadcast on request.
BROADCAST_MOST = 256 << 20


def partition_of(keys: Sequence[str], partitions: int) -> Column:
    """The partition, from 0, that ``exchange`` by hash deals a row to; NULL keys have one too."""
    return F.pmod(F.hash(*keys), F.lit(partitions))


def split(df: DataFrame, keys: Sequence[str], partitions: int) -> list[DataFrame]:
    """The rows of each partition of a dealing by hash."""
    return [df.where(partition_of(keys, partitions) == i) for i in range(partitions)]


def exchange(df: DataFrame, kind: str, keys: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """hash, round_robin, broadcast or gather.

    Broadcast is a hint, given only if Spark's estimate of the rows' size is below ``BROADCAST_MOST``; beyond it
    the planner chooses.  Gather makes one partition: for small results only.
    """
    if kind == "hash":
        return df.repartition(*([partitions] if partitions else []), *keys)
    if kind == "round_robin" and partitions:
        return df.repartition(partitions)
    if kind == "broadcast":
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return F.broadcast(df) if size <= BROADCAST_MOST else df
    if kind == "gather":
        return df.coalesce(1)
    raise InvalidError(f"no exchange {kind!r}")


def grouping(df: DataFrame, kind: str, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """cube, rollup or plain groups."""
    return {"cube": df.cube, "rollup": df.rollup, "groups": df.groupBy}[kind](*keys).agg(*aggregates)


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Groups by each of several sets of keys; a key that isn't in a set is NULL there."""
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(*aggregates)


def set_operation(left: DataFrame, right: DataFrame, kind: str, all_rows: bool = False) -> DataFrame:
    """union, intersect or except by position; ``all_rows`` keeps repeats as often as SQL's ALL does."""
    if kind not in ("union", "intersect", "except"):
        raise InvalidError(f"no set operation {kind!r}")
    if kind == "union":
        out = left.union(right)
        return out if all_rows else out.distinct()
    if kind == "intersect":
        return left.intersectAll(right) if all_rows else left.intersect(right)
    return left.exceptAll(right) if all_rows else left.subtract(right)
