"""Substring deduplication with a log-structured index of window fingerprints.

A window is ``span`` consecutive words.  The index doesn't hold every window: each window is filed under the
least hash among the ``gram``-word sequences in it (winnowing), so equal windows are filed alike whatever
stands around them.  Neighbouring windows filed under the same place form a segment.

The index has two tables, dealt into buckets of files by fingerprint and sorted: the fingerprints, and the
different segments, each with the place where it stands first.  A batch of documents is appended as a sorted
run of immutable files and merge-joined with all runs before it, bucket by bucket, without a shuffle of them:

1. segments equal as a whole to one of a smaller id are covered as a whole;
2. where a new segment has a fingerprint in common with another one, in effect at the ends of shared passages,
   the words are read again and compared window by window.

Fingerprints, made from 64-bit hashes of words, only select.  Equality is decided by 128-bit hashes of the words' own bytes.
After ``fan_in`` runs the files of each bucket are merged into one.

All joins are merge joins: the sides look small as files, but are up to 50 times that in a broadcast's memory,
and the driver would hold it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Bucketed, discard, written

SPAN, GRAM = 50, 16
#: The segments of a fingerprint are dealt over so many buckets, as boilerplate gives many texts the same one.
SALTS = 16
_U = np.uint64
#: Odd multipliers of the hashes, fixed values.
MIX = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * MIX[1]
    return x ^ (x >> _U(29))


class WordHashes:
    """Words to 64-bit hashes, with a cache that is emptied when it is full."""

    def __init__(self, size: int = 400_000):
        self.seen: dict[bytes, int] = {}
        self.size = size

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.seen) > self.size:
            self.seen.clear()
        seen = self.seen
        for w in set(words).difference(seen):
            seen[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n hashes: sum of h[i+k] * m^(n-1-k) modulo 2^64, mixed; by doubling."""
    m = MIX[0]
    with np.errstate(over="ignore"):
        power, done, at, out = m, 1, 0, None
        block = h * MIX[2]
        while True:
            if n & done:
                if out is None:
                    out, at = block, done
                    lead = power
                else:
                    k = min(len(block), len(out) - done)
                    out, at = block[:k] * lead + out[done : done + k], at + done
                    lead = lead * power
            if done * 2 > n:
                break
            k = max(0, len(block) - done)
            block, power, done = block[:k] * power + block[done : done + k], power * power, done * 2
        return _mixed(out)


def window_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of each n neighbours."""
    done = 1
    while done * 2 <= n:
        x, done = np.minimum(x[:-done], x[done:]), done * 2
    return np.minimum(x[: len(x) - (n - done)], x[n - done :]) if n > done else x


def segments(h: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows and fingerprint of each segment."""
    least = window_min(rolling(h, gram), span - gram + 1)
    starts = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    return starts, np.diff(np.r_[starts, len(least)]), least[starts]


class Words:
    """The words of a text, joined by single spaces, and hashes of the bytes of word ranges."""

    def __init__(self, words: list[bytes]):
        self.joined = b" ".join(words)
        self.ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        self.starts = np.r_[0, self.ends[:-1] + 1]

    def hashes(self, at: np.ndarray, n) -> np.ndarray:
        """Two signed 64-bit halves of the hash of each range of n words."""
        view = memoryview(self.joined)
        found = [xxhash.xxh3_128_digest(view[x:y]) for x, y in zip(self.starts[at].tolist(), self.ends[at + n - 1].tolist(), strict=True)]
        return np.frombuffer(b"".join(found), ">i8").astype(np.int64).reshape(-1, 2)


_SCANNED = "rid long, doc long, n_words long, sha string, text binary, at array<int>, n array<int>, f array<long>, a array<long>, b array<long>"
_KINDS = [pa.int64(), pa.string(), pa.binary(), *[pa.list_(pa.int32())] * 2, *[pa.list_(pa.int64())] * 3]


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _scan(span: int, gram: int):
    """(rid, doc, text binary) to one row with the document's words, digest and segments; short texts and rows without a key have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = []
                for doc, t in zip(part.column(1), part.column(2), strict=True):
                    words = (t.as_py() or b"").split()
                    whole = Words(words)
                    row = [len(words), hashlib.sha256(whole.joined).hexdigest(), None, None, None, None, None, None]
                    if len(words) >= span and doc.is_valid:
                        at, n, f = segments(hashes(words), span, gram)
                        ab = whole.hashes(at, n + span - 1)
                        row[2:] = [whole.joined, at.astype(np.int32), n.astype(np.int32), f.view(np.int64), ab[:, 0], ab[:, 1]]
                    rows.append(row)
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names=_names(_SCANNED))

    return run


_WINDOW = "part int, rid long, doc long, at int, a long, b long"


def _windows(span: int):
    """(part, rid, doc, text, at, n) to the hashes of the named windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rid, doc, text, at, n in zip(*batch.columns, strict=True):
                places = [np.arange(x, x + y) for x, y in zip(at.as_py(), n.as_py(), strict=True)]
                where = np.unique(np.concatenate(places))
                ab = Words(text.as_py().split(b" ")).hashes(where, span)
                same = [pa.array([x.as_py()] * len(where), t) for x, t in ((part, pa.int32()), (rid, pa.int64()), (doc, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(where.astype(np.int32)), pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=_names(_WINDOW))

    return run


_KEPT = "doc long, n_words long, n_removed long, kept_sha256 string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, n_words, sha, text, at, n words) to what is left: a null text loses nothing."""
    for batch in batches:
        removed, kept = [], []
        for sha, text, at, n in zip(*batch.columns[2:], strict=True):
            if not text.is_valid:
                removed.append(0)
                kept.append(sha.as_py())
                continue
            words = text.as_py().split(b" ")
            keep = kept_mask(len(words), np.asarray(at.values), np.asarray(n.values))
            removed.append(int(len(words) - keep.sum()))
            kept.append(hashlib.sha256(b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])).hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=_names(_KEPT))


def kept_mask(words: int, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """False where one of the ranges [at, at + n) lies."""
    edge = np.zeros(words + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge)[:words] == 0


class SubstringIndex:
    """Fingerprints and segments of all documents seen so far; batches must come with rising ids to see all that is smaller.

    There are as many buckets as the session has shuffle partitions when the index is made.
    """

    def __init__(self, spark: SparkSession, span: int = SPAN, gram: int = GRAM, fan_in: int = 4):
        self.spark, self.span, self.gram, self.fan_in = spark, span, gram, fan_in
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.prints = Bucketed(spark, "fingerprints", ["f"], buckets)
        self.segments = Bucketed(spark, "segments", ["f", "s"], buckets)
        self.texts: list[Bucketed] = []
        self.runs = 0

    def compact(self) -> None:
        """Merge all runs into one; of a fingerprint that several had one row stays, as of equal segments."""
        self.prints.compact(lambda df: df.groupBy("f").agg(F.min("part").alias("part")))
        self.segments.compact(lambda df: df.where("old is null"))
        self.runs = 1

    def drop(self) -> None:
        for t in (self.prints, self.segments, *self.texts):
            t.drop()

    def add(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """File a batch; (doc, n_words, n_removed, kept_sha256) of its rows, judged by it and all batches before."""
        span, part, later = self.span, len(self.texts), bool(self.texts)
        rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).cast("long").alias("doc"), F.col(text).cast("binary").alias("text"))
        self.texts.append(Bucketed(self.spark, "texts", ["rid"], self.prints.buckets))
        self.texts[part].append(self.texts[part].dealt(rows.mapInArrow(_scan(span, self.gram), _SCANNED)))
        mine = self.texts[part].read()
        placed = mine.where("at is not null").select("rid", "doc", F.explode(F.arrays_zip("at", "n", "f", "a", "b")).alias("x")).select("rid", "doc", "x.*")

        # the different segments, and the least id of an equal one in the runs before
        segs = placed.groupBy("f", F.pmod("a", F.lit(SALTS)).cast("int").alias("s"), "a", "b")
        segs = segs.agg(F.min(F.struct("doc", "rid", "at", "n")).alias("m"), F.max("doc").alias("high")).select("f", "s", "a", "b", "m.*", "high", F.lit(part).alias("part"))
        segs, same = self.segments.dealt(segs), ["f", "s", "a", "b"]
        if later:
            segs = segs.join(self.segments.read().where("old is null").select(*same, F.col("doc").alias("old")).hint("merge"), same, "left")
        else:
            segs = segs.withColumn("old", F.lit(None).cast("long"))
        self.segments.append(segs)
        all_segs = self.segments.read()
        segs = all_segs.where(F.col("part") == part)

        # 1. whole segments
        equal = written(segs.select("a", "b", "high", F.coalesce("old", "doc").alias("first")).where("first < high").drop("high"), "equal")
        ranges = placed.join(equal.hint("merge"), ["a", "b"]).where("first < doc").select("rid", "at", (F.col("n") + span - 1).alias("n"))

        # 2. fingerprints of segments that aren't equal, and the windows of all segments that have them
        prints = segs.groupBy("f").agg(F.min("doc").alias("low"), F.max("doc").alias("top"))
        shared = prints.withColumn("known", F.lit(False))
        if later:
            known = self.prints.read().groupBy("f").agg(F.lit(True).alias("known"))
            shared = prints.join(known.hint("merge"), "f", "left").select("f", "low", "top", F.coalesce("known", F.lit(False)).alias("known"))
        shared = written(shared.where("known or low < top").select("f", "low", "known"), "shared")
        self.prints.append(self.prints.dealt(prints.select("f", F.lit(part).alias("part"))))
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s")
        asked = segs.where("old is null").join(shared.select("*", salts).hint("merge"), ["f", "s"]).where("known or low < doc")
        asked = written(asked.groupBy("f").agg(F.max("doc").alias("top")), "asked")
        places = all_segs.where("old is null").join(asked.select("*", salts).hint("merge"), ["f", "s"]).where("doc <= top")
        places = written(places.select("part", "rid", "at", "n"), "places")
        win = None
        for i, t in enumerate(self.texts):
            ask = places.where(F.col("part") == i).groupBy("rid").agg(F.collect_list("at").alias("ats"), F.collect_list("n").alias("ns"))
            got = t.read().select("rid", "doc", "text").join(ask.hint("merge"), "rid").select(F.lit(i).alias("part"), "rid", "doc", "text", "ats", "ns").mapInArrow(_windows(span), _WINDOW)
            win = got if win is None else win.union(got)
        win = written(win, "windows")
        first = win.groupBy("a", "b").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
        single = win.where(F.col("part") == part).join(first.hint("merge"), ["a", "b"]).where("doc > first").select("rid", "at", F.lit(span).alias("n"))

        gone = ranges.union(single).groupBy("rid").agg(F.collect_list("at").alias("ats"), F.collect_list("n").alias("ns"))
        cut = mine.select("rid", "doc", "n_words", "sha", "text").join(gone.hint("merge"), "rid", "left")
        cut = cut.select("doc", "n_words", "sha", F.when(F.col("ats").isNotNull(), F.col("text")).alias("text"), "ats", "ns")
        out = written(cut.mapInArrow(_cut, _KEPT), "kept")
        discard(equal, shared, asked, places, win)
        self.runs += 1
        if self.runs >= self.fan_in:
            self.compact()
        return out


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = 5, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) of all rows, filed in batches of rising ids, more than the index merges at once.

    Words covered by a window that also starts in a row with a smaller key go; windows are judged on the
    input.  Keys are whole numbers.  Null text: no words.  Rows with a null key neither lose words nor cost
    others any.  Rows with equal keys, repeated rows too, don't cost each other words.  Texts of fewer than
    ``span`` words stay whole; an empty table gives no rows.
    """
    k = F.col(key).cast("long")
    cuts = docs.where(k.isNotNull()).agg(F.percentile_approx(k, [i / batches for i in range(1, batches)] or [0.5])).first()[0]
    cuts = sorted(set(cuts or []))[: batches - 1]
    index = SubstringIndex(docs.sparkSession, span, gram)
    out = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = docs
        if low is not None:
            part = part.where(k > low)
        if high is not None:
            part = part.where((k <= high) | k.isNull() if low is None else k <= high)
        got = index.add(part, key, text)
        out = got if out is None else out.union(got)
    index.drop()
    return out.withColumnRenamed("doc", key)
