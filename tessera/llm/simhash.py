"""SimHash fingerprints and near-duplicate groups by covering locality-sensitive hashing; similar texts by these, then by a prefix join.

Covering: every bit position gets a nonzero vector of GF(2)^(r+1).  Table t, one for each nonzero vector t,
keeps the bits whose vector has an odd product with t.  Two fingerprints that differ in at most r positions
differ in vectors that span at most r dimensions, so some nonzero t is orthogonal to all of them: in that
table both have the same key.  2^(r+1)-1 tables therefore lose no pair within radius r.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, written
from .graph import connected_components

#: A bucket with more distinct fingerprints than this is dealt out as pairs of chunks.
CHUNK = 16384


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of UTF-8 bytes; A-Z lower-cased, words of non-space, word shingles with repeats."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    n = max(1, len(words) - shingle + 1)
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), grams), np.uint64, n)
    return majority(h)


def majority(h: np.ndarray) -> int:
    """Bit i of the result is set if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 65536):
        part = h[k : k + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def with_fingerprint(df: DataFrame, key: str, text: str, shingle: int = 3) -> DataFrame:
    """(key, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["key", "fp"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    return out.mapInArrow(run, f"key {kind}, fp long")


def masks(radius: int = 3) -> list[int]:
    """The 2^(radius+1)-1 bit masks of the covering, as signed longs; position i has the vector 1 + i mod (2^(radius+1)-1)."""
    n = 2 ** (radius + 1) - 1
    out = []
    for t in range(1, n + 1):
        m = sum(1 << i for i in range(64) if bin((1 + i % n) & t).count("1") % 2)
        out.append(m - (1 << 64) if m >= 1 << 63 else m)
    return out


def links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph that joins unsigned fingerprints within the radius.

    Breadth-first over what is still unvisited: in a dense bucket the first steps take nearly all of it.
    Both ends of an edge are within the radius of each other.
    """
    rest, members, froms = fps, [], []
    while rest.size > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and rest.size:
            at = todo.pop()
            near = np.bitwise_count(rest ^ at) <= radius
            if near.any():
                found = rest[near]
                rest = rest[~near]
                todo.extend(found)
                members.append(found)
                froms.append(np.full(found.size, at))
    if not members:
        return fps[:0], fps[:0]
    return np.concatenate(members), np.concatenate(froms)


def _bucket_links(radius: int):
    """Rows sorted by bucket to edges; a bucket's rows are held, at most two chunks of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[np.ndarray, np.ndarray] | None = None

        def solve(ids: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            ends = np.flatnonzero(ids[1:] != ids[:-1]) + 1
            for part in np.split(fps, ends):
                a, b = links(part.view(np.uint64), radius)
                if a.size:
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["src", "dst"])

        for batch in batches:
            ids, fps = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            if kept is not None:
                ids, fps = np.concatenate([kept[0], ids]), np.concatenate([kept[1], fps])
            if not len(ids):
                continue
            other = np.flatnonzero(ids != ids[-1])
            cut = int(other[-1]) + 1 if other.size else 0  # the last bucket may go on in the next batch
            yield from solve(ids[:cut], fps[:cut])
            kept = ids[cut:], fps[cut:]
        if kept is not None:
            yield from solve(*kept)

    return run


def near_pairs(fps: DataFrame, radius: int = 3, chunk: int = CHUNK) -> DataFrame:
    """Distinct long ``fp`` to (src, dst) edges whose components are those of all pairs within ``radius``.

    Bucket sizes are counted with partial aggregation.  A bucket of two is its own pair; larger ones are joined
    back and solved bucket by bucket; those of more than ``chunk`` fingerprints are dealt as pairs of chunks,
    so that no task holds more than two chunks, and no pair is lost.
    """
    keys = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks(radius)])).alias("t", "k"))
    size = keys.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    size = written(size, "buckets")
    two = size.where(f"n = 2 and bit_count(a ^ b) <= {int(radius)}").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    many = keys.join(size.where("n > 2").select("t", "k", F.ceil(F.col("n") / chunk).cast("int").alias("g")), ["t", "k"])
    part = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
    tile = F.when(F.col("g") == 1, F.array(F.lit(0))).otherwise(
        F.expr("transform(filter(sequence(0, g - 1), j -> j <> p), j -> least(j, p) * g + greatest(j, p))")
    )
    many = many.withColumn("p", part).withColumn("tile", F.explode(tile))
    many = many.select(F.xxhash64("t", "k", "tile").alias("bucket"), "fp")
    many = many.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_links(radius), "src long, dst long")
    return two.union(many)


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(key, fp long, component): component is the smallest key reachable over links of ``radius`` bits.

    Null or empty text: fingerprint 0, linked like any other.  A null key never names a component unless
    all keys of the component are null; repeated rows come out as often as they came in.  Equal fingerprints
    are reduced to one before anything is compared, so groups of copies cost nothing.  Components come back to
    the rows by a broadcast of the at most 4,096 fingerprints that hold a 4,096th of the rows or more each, and
    by a shuffle of the rows of all others, so that no group of copies meets in one task.
    """
    docs = written(with_fingerprint(df, key, text, shingle), "fingerprints")
    reps = docs.groupBy("fp").agg(F.min("key").alias("low"), F.count(F.lit(1)).alias("n"))
    roots = connected_components(near_pairs(reps.select("fp"), radius)).withColumnRenamed("node", "fp")
    linked = written(roots.join(reps.select("fp", "low"), "fp"), "linked")
    low = linked.groupBy("root").agg(F.min("low").alias("component"))
    linked = linked.join(low, "root").select("fp", "component")
    by_fp = written(reps.join(linked, "fp", "left").select("fp", F.coalesce("component", "low").alias("component"), "n"), "components")
    large = F.col("n") * 4096 >= docs.count()
    hot, cold = F.broadcast(by_fp.where(large).drop("n")), by_fp.where(~large).drop("n")
    out = docs.join(hot, "fp").unionByName(docs.join(hot.select("fp"), "fp", "left_anti").join(cold, "fp"))
    return out.select(F.col("key").alias(key), "fp", "component")


def word_set_fingerprints(text: bytes | None, seeds: tuple[int, ...]) -> list[int]:
    """One SimHash over the set of a text's lower-cased words for each seed: a changed word moves few bits."""
    words = sorted(set((text or b"").lower().split()))
    if not words:
        return [0] * len(seeds)
    return [majority(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=s), words), np.uint64, len(words))) for s in seeds]


def shingle_set(text: bytes, shingle: int) -> set[bytes]:
    words = text.lower().split()
    return {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}


def jaccard(a: bytes, b: bytes, shingle: int) -> float:
    """Of the sets of word shingles; two texts without words are equal."""
    x, y = shingle_set(a, shingle), shingle_set(b, shingle)
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """Sorted unsigned 64-bit hashes of the set of word shingles."""
    s = shingle_set(text, shingle)
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, s), np.uint64, len(s)))


def common_shingles(texts: DataFrame, rows: int, shingle: int, sample: int = 20_000, share: float = 0.05, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of shingles that are common in a sample of (node, text): ``sample`` texts or a ``share`` of all.

    They only decide the order in which prefixes are taken; any order gives the same groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [shingle_hashes(t.as_py(), shingle) for t in b.column(0)]
            if h:
                u, n = np.unique(np.concatenate(h), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])

    part = min(1.0, max(share, sample / max(1, rows)))
    some = texts.where(F.pmod(F.xxhash64("node", F.lit(9)), F.lit(1 << 20)) < int(part * (1 << 20))).select("text")
    counts = some.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n > 2")
    got = counts.orderBy(F.desc("n"), "token").limit(most).toPandas()
    h, n = got["token"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def prefix_of(h: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The rarest hashes of a set, by (count, hash), so many that two sets with Jaccard ``least`` or more share one of them."""
    rank, (hot, n) = np.zeros(len(h), np.int64), common
    if len(hot):
        i = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
        rank = np.where(hot[i] == h, n[i], 0)
    return h[np.lexsort((h, rank))][: len(h) - int(np.ceil(least * len(h) - 1e-9)) + 1]


def with_prefixes(texts: DataFrame, common, shingle: int, least: float) -> DataFrame:
    """(token, node, size, at): the prefix of each (node, text), with the size of its set and the place of each token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = common.value
        for b in batches:
            sets = [shingle_hashes(t.as_py(), shingle) for t in b.column(1)]
            heads = [prefix_of(h, order, least) for h in sets]
            if not heads:
                continue
            times = np.array([len(h) for h in heads])
            token = np.concatenate(heads).view(np.int64)
            node = np.repeat(b.column(0).to_numpy(zero_copy_only=False), times)
            size = np.repeat(np.array([len(h) for h in sets], np.int32), times)
            at = np.concatenate([np.arange(n, dtype=np.int32) for n in times])
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(node), pa.array(size), pa.array(at)], names=["token", "node", "size", "at"])

    return texts.select("node", "text").mapInArrow(run, "token long, node long, size int, at int")


def may_reach(size: np.ndarray, at: np.ndarray, size2, at2, least: float) -> np.ndarray:
    """Whether sets that share a token at these places, and none before, can have Jaccard ``least``."""
    both = np.minimum(size - at, size2 - at2)
    return both * (1 + least) >= least * (size + size2) - 1e-6


def _bucket_pairs(least: float, star: bool):
    """Rows (bucket, node, size, at, root, p, q), sorted by bucket, to candidate pairs of different roots.

    ``star``: each row with the first of its bucket only, a bucket's rows are not held.  Else each with each,
    and in a bucket of two chunks p <> q only those of different chunks.
    """

    def pairs(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        _, node, size, at, root, p, q = cols
        for i in range(len(node) - 1):
            ok = may_reach(size[i + 1 :], at[i + 1 :], size[i], at[i], least) & (root[i + 1 :] != root[i])
            ok &= (p[i + 1 :] != p[i]) | (q[i] == 1)
            if ok.any():
                yield from emit(np.full(int(ok.sum()), node[i]), node[i + 1 :][ok])

    def emit(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["src", "dst"])

    def gathered(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for x in parts:
            held.append(x)
            n += len(x)
            if n >= 50_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if kept is not None:
                cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
            if not len(cols[0]):
                continue
            ids = cols[0]
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            if star:
                head = np.repeat(starts, np.diff(np.r_[starts, len(ids)]))
                ok = (cols[4] != cols[4][head]) & may_reach(cols[2], cols[3], cols[2][head], cols[3][head], least)
                if ok.any():
                    yield from emit(cols[1][head][ok], cols[1][ok])
                kept = [c[starts[-1] : starts[-1] + 1] for c in cols]
                continue
            ends = np.r_[starts[1:], len(ids)]
            for s, e in zip(starts[:-1], ends[:-1], strict=True):
                yield from pairs([c[s:e] for c in cols])
            kept = [c[starts[-1] :] for c in cols]
        if kept is not None and not star:
            yield from pairs(kept)

    return lambda batches: gathered(solve(batches))


def _in_buckets(rows: DataFrame, order: list, least: float, star: bool) -> DataFrame:
    rows = rows.select("bucket", "node", "size", "at", "root", "p", "q", *[o.alias(f"o{i}") for i, o in enumerate(order)])
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", *[f"o{i}" for i in range(len(order))])
    return rows.select("bucket", "node", "size", "at", "root", "p", "q").mapInArrow(_bucket_pairs(least, star), "src long, dst long").distinct()


def fingerprint_pairs(texts: DataFrame, radius: int = 3) -> DataFrame:
    """(src, dst), src < dst: distinct pairs of (node, text) whose fingerprints link them within ``radius`` bits.

    Each text with the first one of the same fingerprint, and the first ones along the links of ``near_pairs``:
    the components are those of all pairs within ``radius``.
    """
    prints = written(with_fingerprint(texts, "node", "text"), "simhashes")
    heads = written(prints.groupBy("fp").agg(F.min("key").alias("head")), "heads")
    same = prints.join(heads.hint("merge"), "fp").select(F.col("head").alias("a"), F.col("key").alias("b"))
    ends = [heads.select(F.col("fp").alias(end), F.col("head").alias(x)).hint("merge") for end, x in (("src", "a"), ("dst", "b"))]
    linked = near_pairs(heads.select("fp"), radius).distinct().join(ends[0], "src").join(ends[1], "dst").select("a", "b")
    return same.union(linked).where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def similar_groups(df: DataFrame, key: str, text: str, shingle: int = 5, least: float = 0.8, chunk: int = 4096, radius: int = 3) -> DataFrame:
    """(rid, key, root): groups of texts with Jaccard similarity ``least`` or more over word shingles.

    ``rid`` is a hash of key and text.  Texts with equal word sequences (A-Z lower-cased) form a class that
    stands as one.  First the links of the classes' SimHash fingerprints, as in ``near_groups``, are verified.
    Similar texts may differ in more bits than ``radius``; an exact join finds them: in any one order of all
    shingles, two sets that are similar enough share one of the first
    (1 - least) of each, so the classes are bucketed by these, rare shingles first; sizes and places
    rule out more.  Two rounds compare each class with one head of each of its buckets, which ties large groups
    of near copies together; then all pairs of a bucket that aren't in one group yet are compared, buckets of more
    than ``chunk`` rows as pairs of chunks.  Every candidate is verified on whole texts, and no pair is lost.
    Null and empty texts are one class; repeated rows have one ``rid``; an empty table gives no rows.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls = [xxhash.xxh3_64_intdigest(b" ".join((t.as_py() or b"").lower().split())) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(cls, np.uint64).view(np.int64))], names=["rid", "key", "cls"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [jaccard(x.as_py(), y.as_py(), shingle) >= least for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], names=["src", "dst", "ok"])

    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    body = df.select(F.xxhash64(key, text).alias("rid"), F.col(key).alias("key"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    rows = written(body.mapInArrow(scan, f"rid long, key {kind}, cls long"), "fingerprints")
    classes = written(rows.groupBy("cls").agg(F.min("rid").alias("node")), "classes")
    texts = written(body.select(F.col("rid").alias("node"), "text").join(classes.select("node"), "node").groupBy("node").agg(F.first("text").alias("text")), "texts")
    common = spark.sparkContext.broadcast(common_shingles(texts, classes.count(), shingle))
    every = written(with_prefixes(texts, common, shingle, least), "prefixes")
    common.destroy()
    several = every.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("token")
    pre = written(every.join(several, "token"), "shared")
    discard(every)
    checked, roots = None, None

    def check(pairs: DataFrame) -> None:
        """Verify candidates that are new, and join their groups."""
        nonlocal checked, roots
        if checked is not None:
            pairs = pairs.join(checked.select("src", "dst"), ["src", "dst"], "left_anti")
        pairs = written(pairs, "candidates")
        both = pairs.join(texts.select(F.col("node").alias("src"), F.col("text").alias("a")), "src").join(texts.select(F.col("node").alias("dst"), F.col("text").alias("b")), "dst")
        new = written(both.select("src", "dst", "a", "b").mapInArrow(verify, "src long, dst long, ok boolean"), "checked")
        checked = new if checked is None else checked.union(new)
        discard(pairs)
        roots = written(connected_components(checked.where("ok").select("src", "dst")), "roots")

    def open_rows() -> DataFrame:
        """Prefix rows of the buckets that hold more than one group."""
        named = pre.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_tokens = named.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("token")
        return named.join(open_tokens, "token").withColumn("bucket", F.col("token")).withColumn("p", F.lit(0)).withColumn("q", F.lit(1))

    check(fingerprint_pairs(texts, radius))
    check(_in_buckets(open_rows(), [F.col("node")], least, True))
    check(_in_buckets(open_rows(), [F.col("at"), F.xxhash64("node")], least, True))
    rest = written(open_rows(), "rest")
    size = rest.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("g"))
    part = F.pmod(F.xxhash64("node"), F.col("g")).cast("int")
    tile = F.expr("case when g = 1 then array(struct(0 as i, 1 as q)) else transform(sequence(0, g - 1), j -> struct(least(j, p) * g + greatest(j, p) as i, int(j = p) as q)) end")
    tiles = rest.drop("p", "q").join(size, "token").withColumn("p", part).withColumn("tile", F.explode(tile))
    tiles = tiles.withColumn("bucket", F.xxhash64("token", "tile.i")).withColumn("q", F.col("tile.q"))
    check(_in_buckets(tiles, [F.col("node")], least, False))
    discard(texts, pre, rest)
    named = classes.join(roots, "node", "left").select("cls", F.coalesce("root", "node").alias("root"))
    return rows.select("rid", "key", "cls").join(named, "cls").select("rid", "key", "root")


def near_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows that stay: of each group of similar texts, copies and repeated rows included, the one with the smallest key.

    Null keys come last, ties go by a hash of key and text, and of rows equal in both one stays.  Null and
    empty texts are copies of each other.  Columns are as they were, whatever their names.
    """
    groups = written(similar_groups(df, key, text, **options), "groups")
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("n"), "key", "rid")).alias("m")).select("root", F.col("m.rid").alias("stay"))
    gone = written(groups.join(best, "root").where("rid <> stay").select("rid").distinct(), "removed")
    again = written(groups.groupBy("rid").count().where("count > 1").select("rid").join(gone, "rid", "left_anti"), "repeated")
    discard(groups)
    rid = fresh(df, "_rid")
    out = df.withColumn(rid, F.xxhash64(key, text)).join(gone.withColumnRenamed("rid", rid), rid, "left_anti")
    if again.limit(1).count():
        more = again.withColumnRenamed("rid", rid)
        out = out.join(more, rid, "left_anti").unionByName(out.join(more, rid, "left_semi").dropDuplicates([rid]))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])
