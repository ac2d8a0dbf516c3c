"""Benchmark decontamination by pigeonhole edit matching.

An item of L characters may differ by k = floor(rate x L) edits, at least one.  Cut into k+1 pieces, one piece
of every match within the budget is untouched.  An Aho-Corasick automaton finds exact pieces in the whole
text; around each hit Myers' bit-parallel distance decides.  Short items count only as they are, as whole words.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

_WORD = regex.compile(r"[\p{L}\p{N}]+")
#: Letters of scripts that don't set words apart.
_JOINED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")


def normal(text: str) -> str:
    """Lower case, letters and digits only, words set apart by one blank."""
    return " ".join(_WORD.findall(text.lower()))


def budget(length: int, rate: float) -> int:
    return max(1, int(length * rate))


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of even length with their places; fewer if the item is shorter than that."""
    n = min(errors + 1, len(item))
    cuts = [len(item) * i // n for i in range(n + 1)] if n else [0]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(masks: dict[str, int], m: int, text: str, most: int) -> tuple[int, int]:
    """Least edit distance of a pattern of m characters to any part of the text, and where that part ends; stops at 0."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, most + 1, -1
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, i + 1
            if not best:
                break
    return best, end


def char_masks(item: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        out[c] |= 1 << i
    return dict(out)


def whole_words(text: str, start: int, end: int) -> bool:
    """Whether a part of a normalized text cuts no word; between letters of scripts without gaps any cut will do."""
    return all(
        i in (0, len(text)) or " " in text[i - 1 : i + 1] or _JOINED.search(text[i - 1 : i + 1]) is not None
        for i in (start, end)
    )


class Matcher:
    """A block of items, searched for in normalized texts; those of fewer than ``least`` characters without errors."""

    def __init__(self, items: list[tuple[int, str]], rate: float, least: int = 40):
        import ahocorasick

        self.items = []
        owners: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            k = budget(len(text), rate) if len(text) >= least else 0
            for at, piece in pieces(text, k):
                owners[piece].append((len(self.items), at))
            self.items.append((item_id, len(text), k, char_masks(text)))
        self.automaton = ahocorasick.Automaton()
        for piece, who in owners.items():
            self.automaton.add_word(piece, (len(piece), who))
        if owners:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item, distance, end) of the best match of every item within its budget."""
        if not len(self.automaton):
            return []
        starts: dict[int, list[int]] = defaultdict(list)
        for end, (size, who) in self.automaton.iter(text):
            for i, at in who:
                starts[i].append(end + 1 - size - at)
        out = []
        for i, places in starts.items():
            item_id, m, k, masks = self.items[i]
            if not k:
                s = next((s for s in places if whole_words(text, s, s + m)), None)
                if s is not None:
                    out.append((item_id, 0, s + m))
                continue
            best, found, upto = k + 1, -1, -1
            for s in sorted(set(places)):
                # a match that holds this piece lies within k of where the piece puts it
                low, high = max(0, s - k), min(len(text), s + m + k)
                if high <= upto or best == 0:
                    continue
                low = max(low, upto - m - 2 * k) if upto > low else low
                d, e = myers(masks, m, text[low:high], k)
                upto = high
                if d < best:
                    best, found = d, low + e
            if best <= k:
                out.append((item_id, best, found))
        return out


def _matches(rate: float, least: int, items):
    """Rows (rid, text) to matches; an item here is the place of a text in the block, whose ids all match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher([(i, n) for i, (n, _) in enumerate(items.value)], rate, least)
        for b in batches:
            rows: list[list] = [[], [], [], []]
            for rid, t in zip(b.column(0), b.column(1), strict=True):
                for at, d, end in matcher.find(normal(t.as_py() or "")):
                    for item in items.value[at][1]:
                        for c, v in zip(rows, (rid.as_py(), item, d, end), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.int64())], names=["rid", "item_id", "distance", "match_end"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", rate: float = 0.06, least: int = 40, block_mb: float = 8, rid: Column | None = None) -> DataFrame:
    """(rid, item_id, distance, match_end): each item within its error budget in each text, ``rid`` a hash of the text.

    Lengths and distances are in characters of normalized text; ``match_end`` is where the best match ends
    in it.  Items shorter than ``least`` normalized characters match only without errors and as whole words, those
    without a letter or digit nothing; of equal items each id matches.  Null and empty texts match nothing,
    repeated rows match alike, and ids of items are whole numbers.  Results don't depend on the blocks.

    The items, a stated query set, are dealt into blocks of about ``block_mb`` MB by hash, and each block,
    bounded in size, is sent to the tasks that search all texts.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("t")).where("t is not null and item_id is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / (block_mb * (1 << 20))))
    rows = docs.select((F.xxhash64(text) if rid is None else rid).alias("rid"), F.col(text).alias("text"))
    out = None
    for k in range(blocks):
        got: dict[str, set[int]] = defaultdict(set)
        for r in items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k).toLocalIterator():
            if n := normal(r["t"]):
                got[n].add(r["item_id"])
        shared = spark.sparkContext.broadcast([(n, sorted(ids)) for n, ids in sorted(got.items())])
        part = rows.mapInArrow(_matches(rate, least, shared), "rid long, item_id long, distance int, match_end long")
        out = part if out is None else out.union(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows whose text holds no item of the benchmark within its error budget, columns as they were, whatever their names.

    Null and empty texts stay; repeated rows share their fate.  Leaking texts are few: their hashes are
    written, and Spark broadcasts the file if it is below the threshold and else joins by a shuffle.
    """
    rid = fresh(docs, "_rid")
    leaks = written(find_leaks(docs, benchmark, text, **options).select("rid").distinct(), "leaks")
    out = docs.withColumn(rid, F.xxhash64(text)).join(leaks.withColumnRenamed("rid", rid), rid, "left_anti")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def leak_table(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, item_id, distance, contaminated) for each leak of each row; a row without leaks has one line with nulls.

    Repeated rows and rows with equal keys have lines of their own; see ``find_leaks`` for nulls and equal items.
    """
    rows = docs.select(F.col(key), F.xxhash64(text).alias("rid"))
    leaks = written(find_leaks(docs, benchmark, text, **options).groupBy("rid", "item_id").agg(F.min("distance").alias("distance")), "leaks")
    return rows.join(leaks, "rid", "left").select(key, "item_id", "distance", F.col("item_id").isNotNull().alias("contaminated"))
