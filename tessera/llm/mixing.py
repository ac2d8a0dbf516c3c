"""Mixing sources to target weights by hierarchical budgets over a domain-language-source tree.

A token budget goes down the tree.  At each node the children share it by weight; a child that can't use its
share, because all its documents times the epochs allowed hold less, takes what it has, and its siblings
share the rest.  A node's capacity is the sum of its leaves', so only what all siblings together can't use
comes back to their parent's siblings.  Each leaf then takes whole epochs and the prefix of one more, each
epoch in an order of its own that seed, epoch and document decide.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, words_sql, written

LEVELS = ("domain", "lang", "source")
#: Hex digits of the order key that make a leaf's ranges: 16^3 of them.
RANGE_DIGITS = 3


def share_out(nodes: DataFrame, parent: Sequence[str], weight: str, capacity: str, budget: str, name: str) -> DataFrame:
    """Add ``name``: the tokens (long) of each node, siblings being those with equal ``parent`` columns.

    Water filling in one pass: siblings in order of capacity per weight; one is full if the level that the
    nodes before it leave, (budget - their capacities) / weights from it on, reaches its capacity per weight.
    All sums are of integers, so the order of rows doesn't matter.  A weight of 0 gets nothing.
    """
    ratio = F.when(F.col(weight) > 0, F.col(capacity) / F.col(weight)).otherwise(F.lit(float("inf")))
    w = Window.partitionBy(*parent).orderBy("_r", weight, capacity, "_k")
    up = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = nodes.withColumn("_r", ratio)
    rows = rows.withColumn("_before", F.coalesce(F.sum(capacity).over(up), F.lit(0)))
    rows = rows.withColumn("_rest", F.sum(weight).over(w.rowsBetween(0, Window.unboundedFollowing)))
    full = (F.col(weight) > 0) & (F.col("_r") * F.col("_rest") <= F.col(budget) - F.col("_before"))
    rows = rows.withColumn("_full", full)
    # the level for those that aren't full: what the full ones leave, by the others' weights
    all_of = Window.partitionBy(*parent)
    rows = rows.withColumn("_left", F.col(budget) - F.sum(F.when(F.col("_full"), F.col(capacity)).otherwise(0)).over(all_of))
    rows = rows.withColumn("_open", F.sum(F.when(F.col("_full"), 0).otherwise(F.col(weight))).over(all_of))
    part = F.when(F.col("_open") > 0, F.floor(F.col("_left") * F.col(weight) / F.col("_open"))).otherwise(F.lit(0))
    got = F.when(F.col("_full"), F.col(capacity)).otherwise(F.least(F.greatest(part, F.lit(0)), F.col(capacity)))
    return rows.withColumn(name, got.cast("long")).drop("_r", "_before", "_rest", "_full", "_left", "_open")


def leaf_targets(leaves: DataFrame, weights: Mapping[str, Mapping[str, int]], share: tuple[int, int], epochs: int, levels: Sequence[str] = LEVELS) -> DataFrame:
    """Leaves (levels, tokens) plus target.  The budget is share[0] / share[1] of all tokens.

    ``weights``: level to value to whole weight; a value that isn't named weighs 1.
    """
    node = leaves.withColumn("cap0", F.col("tokens") * epochs)
    total = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * share[0] / share[1]).cast("long").alias("b")).first()["b"]
    node = node.withColumn("_b", F.lit(total)).withColumn("_k", F.lit(0))
    for depth, level in enumerate(levels):
        own, above = levels[: depth + 1], levels[:depth]
        table = weights.get(level) or {}
        w = F.lit(1)
        if table:
            w = F.coalesce(F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv])[F.col(level)], F.lit(1))
        tier = node.groupBy(*own).agg(F.sum("cap0").alias("cap"), F.first("_b").alias("_b"))
        tier = tier.withColumn("w", w.cast("long")).withColumn("_k", F.coalesce(F.col(level), F.lit("")))
        tier = share_out(tier, above, "w", "cap", "_b", "_got").select(*[F.col(c).alias(f"_{c}") for c in own], "_got")
        on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in own]
        node = written(node.join(tier, on).withColumn("_b", F.col("_got")).drop("_got", *[f"_{c}" for c in own]), f"tier{depth}")
    return node.withColumnRenamed("_b", "target").drop("cap0", "_k")


def with_domain(df: DataFrame, domains: Mapping[str, str], name: str = "domain", other: str = "web") -> DataFrame:
    """The domain of each source by a table of exceptions; every other source belongs to ``other``."""
    d = F.lit(other)
    if domains:
        d = F.coalesce(F.create_map(*[F.lit(x) for kv in sorted(domains.items()) for x in kv])[F.col("source")], d)
    return df.withColumn(name, d)


def order_key(seed: int, epoch, key: str):
    """Hex text that orders a leaf's documents in an epoch."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def plan_mixture(docs: DataFrame, weights: Mapping[str, Mapping[str, int]], domains: Mapping[str, str], share: tuple[int, int] = (1, 2), epochs: int = 2, seed: int = 17, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, rid, tokens, domain, lang, source, epoch): one row for each time a document is taken.

    Tokens are words.  A partial epoch takes documents in its order up to where the target falls; the one in
    which it falls is taken if at least half of it fits, so a leaf misses its target by half a document.  Texts without words are never taken; null lang or source is a value of its own.  Of
    equal order keys, as of repeated rows, the one with fewer tokens goes first, then by a hash of the text.

    A leaf's order is cut into 4,096 ranges.  The tokens of ranges are summed with partial aggregation;
    running sums over ranges tell which are taken whole; only the one range where the target falls is sorted.
    """
    rows = with_domain(docs, domains).select(F.col(key), F.xxhash64(key, text).alias("rid"), F.expr(f"size({words_sql(f'`{text}`')})").cast("long").alias("tokens"), *LEVELS)
    rows = written(rows.where("tokens > 0"), "tokens")
    leaves = written(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "leaves")
    goal = leaf_targets(leaves, weights, share, epochs)
    leaf = F.xxhash64(*[F.coalesce(c, F.lit("\0null")) for c in LEVELS])
    goal = goal.select(leaf.alias("leaf"), (F.col("target") / F.col("tokens")).cast("long").alias("whole"), (F.col("target") % F.col("tokens")).alias("rest"))
    goal = written(goal, "targets")
    at = rows.withColumn("leaf", leaf).join(goal, "leaf")
    taken = at.where("whole > 0").select(key, "rid", "tokens", *LEVELS, F.explode(F.expr("sequence(0, cast(whole as int) - 1)")).alias("epoch"))
    last = at.where("rest > 0").withColumn("epoch", F.col("whole").cast("int")).withColumn("h", order_key(seed, F.col("epoch"), key)).withColumn("range", F.substring("h", 1, RANGE_DIGITS))
    sums = last.groupBy("leaf", "range").agg(F.sum("tokens").alias("sum"))
    sums = sums.withColumn("upto", F.sum("sum").over(Window.partitionBy("leaf").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)))
    sums = written(sums, "ranges")
    last = last.join(sums, ["leaf", "range"])
    most = last.where("upto <= rest")
    edge = last.where("upto > rest and upto - sum < rest")
    order = Window.partitionBy("leaf").orderBy("h", "tokens", "rid").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("run", F.col("upto") - F.col("sum") + F.sum("tokens").over(order)).where("2 * run - tokens <= 2 * rest")
    cols = [F.col(c) for c in (key, "rid", "tokens", *LEVELS, "epoch")]
    return taken.select(*cols).union(most.select(*cols)).union(edge.select(*cols))


def mix(docs: DataFrame, weights: Mapping[str, Mapping[str, int]], domains: Mapping[str, str], key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows taken, each as often as it is taken, with their columns as they were, whatever their names."""
    rid, epoch = fresh(docs, "_rid"), fresh(docs, "_epoch")
    plan = plan_mixture(docs, weights, domains, key=key, text=text, **options)
    times = written(plan.select(F.col("rid").alias(rid), F.col("epoch").alias(epoch)).distinct(), "taken")
    out = docs.withColumn(rid, F.xxhash64(key, text)).join(times, rid)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
