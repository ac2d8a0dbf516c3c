"""Language-model scores of whole texts, beside a smoothed word-frequency base.

Passes over the corpus: (1) words of the training rows are counted; (2) all texts are split and their subword ids
written, two bytes each, so that no later pass splits or looks up words; (3) the attention model is warmed up in
one task on a bounded sample of passages, then every split of these ids trains on all words of its training texts and
the split's parameters are averaged, so what is gathered grows with the corpus; (4) all texts are scored.

The commonest words, a bounded number, travel with the tasks; all other words of the texts are joined with the
table of counts by a shuffle, so no word is lost however many there are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .attention import Model, Trainer, keep_freed, windows
from .common import setting, written

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
#: Ids of that vocabulary.
ALL_IDS = 32_000
#: Parameters with their defaults: most ids of the model (all ids of the vocabulary, rare and end), words that travel with tasks, tokens of the warm-up sample (gone over anew if the corpus has fewer), tokens of a training step of the warm-up and of a split.
SETTINGS = {"vocabulary": ALL_IDS + 2, "head_words": 100_000, "warm_tokens": 4_000_000, "step_tokens": 4096, "split_tokens": 16_384, "rate": 0.01}


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def slices(texts: pa.Array, most: int = 8 << 20) -> Iterator[pa.Array]:
    """Runs of texts of about at most so many bytes together; a longer text is alone."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield texts.slice(a, b - a)
        a = b


def coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts, all words as places among them, and how many each text has; words as ``words_of`` tells them."""
    texts = texts.fill_null(b"")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.large_string() if pa.types.is_large_binary(texts.type) else pa.string())))
    flat, of = split.flatten(), pc.list_parent_indices(split).to_numpy()
    real = pc.greater(pc.binary_length(flat), 0)  # spaces at the ends split off empty strings
    sizes = np.bincount(of[real.to_numpy(zero_copy_only=False)], minlength=len(texts))
    words = flat.filter(real).dictionary_encode()
    large = pa.types.is_large_string(words.dictionary.type)
    return words.dictionary.view(pa.large_binary() if large else pa.binary()).cast(pa.binary()), words.indices.to_numpy(), sizes


def encoder(path: str):
    """Words to lists of subword ids."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return lambda words: model.encode([w.decode("utf-8", "replace") for w in words], num_threads=1)


class Subwords:
    """Words to model ids, each distinct word encoded once for as long as the cache holds it.

    A full cache drops the words that are not in ``logs``, the commonest of the corpus, and goes on.

    The model's ids are the subword ids of the training texts by rank; all others are one token, ``rare``, whose
    probability is spread evenly over them; the last id is the end of a text.
    """

    def __init__(self, path: str, ids: list[int], v: int, logs: dict[bytes, float] | None = None, size: int = 150_000):
        self.encode = encoder(path)
        self.rank = np.full(ALL_IDS, len(ids), np.int32)
        self.rank[ids] = np.arange(len(ids))
        self.rare, self.size, self.logs = len(ids), size, logs or {}
        self.common, self.common_logs = pa.array(list(self.logs), pa.binary()), np.array([*self.logs.values(), np.nan])
        self.reset()

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct words one after the other, how many each has, and the words' ``logs``.

        Without the cache: of many distinct words, most are rare, and encoding them all costs less than looking each up.
        """
        lists = self.encode(words.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = self.rank[np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))].astype(np.uint16)
        at = pc.index_in(words, value_set=self.common).fill_null(len(self.logs)).to_numpy()
        return flat, sizes, self.common_logs[at]

    def reset(self) -> None:
        self.at: dict[bytes, int] = {}
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.known = np.full(1 << 16, np.nan)
        self.pool, self.used = np.zeros(1 << 18, np.int32), 0

    def _grow(self, name: str, n: int) -> np.ndarray:
        a = getattr(self, name)
        if n > len(a):
            a = np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])
            setattr(self, name, a)
        return a

    def places(self, words: list[bytes]) -> np.ndarray:
        """Rows of the cache for words, new ones added."""
        if len(self.at) > self.size:
            self._keep_common()
        rows = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(rows < 0).tolist()
        if missing:
            new = list({words[i] for i in missing})
            lists = self.encode(new)
            sizes = np.fromiter(map(len, lists), np.int32, len(new))
            flat = self.rank[np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))]
            self._add(new, flat, sizes, np.array([self.logs.get(w, np.nan) for w in new]))
            rows[missing] = [self.at[words[i]] for i in missing]
        return rows

    def _add(self, words: list[bytes], flat: np.ndarray, sizes: np.ndarray, known: np.ndarray) -> None:
        n, base = len(words), len(self.at)
        self._grow("pool", self.used + len(flat))[self.used : self.used + len(flat)] = flat
        self._grow("starts", base + n)[base : base + n] = self.used + np.cumsum(sizes) - sizes
        self._grow("sizes", base + n)[base : base + n] = sizes
        self._grow("known", base + n)[base : base + n] = known
        self.used += len(flat)
        self.at.update(zip(words, range(base, base + n), strict=True))

    def _keep_common(self) -> None:
        words = [w for w in self.at if w in self.logs]
        rows = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        flat, sizes, known = self.ids(rows), self.sizes[rows], self.known[rows]
        self.reset()
        self._add(words, flat, sizes, known)

    def ids(self, rows: np.ndarray) -> np.ndarray:
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(self.starts[rows] - (ends - sizes), sizes) + np.arange(total)]


_held: dict[str, Subwords] = {}


def held_subwords(name: str, *given) -> Subwords:
    """The subwords of one fit, kept by a Python worker from task to task."""
    if name not in _held:
        _held.clear()
        _held[name] = Subwords(*given)
    return _held[name]


def small_batches(spark: SparkSession):
    """Batches to Python of at most 2,000 rows, so that the buffers on both sides stay small where texts are long."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def count_words(texts: DataFrame) -> DataFrame:
    """(word binary, c) of a (text binary) table; counted in slices of texts, then by Spark before and after the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for texts in slices(b.column(0)):
                words, codes, _ = coded(texts)
                yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(codes, minlength=len(words)), pa.int64())], names=["word", "c"])

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def commonest(counts: DataFrame, most: int) -> DataFrame:
    """The commonest words of (word, c), at most so many: all words down to a level of counts, 64 levels to a doubling.

    No partition sends words of its own choice, so that what the driver collects is bounded however many there are.
    """
    level = F.floor(F.log2("c") * 64)
    lowest, held = None, 0
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # at most 64 x 64 rows
        held += r["count"]
        if held > most:
            break
        lowest = r["level"]
    return counts.where(F.lit(False) if lowest is None else level >= lowest)


def _commonest_ids(counts: DataFrame, tokenizer: str, n: int) -> list[tuple[int, int]]:
    """(id, count) of the commonest subword ids, from the counts of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, total = encoder(tokenizer), np.zeros(ALL_IDS, np.int64)
        for b in batches:
            lists = encode(b.column(0).to_pylist())
            times = np.repeat(b.column(1).to_numpy(), np.fromiter(map(len, lists), np.int64, len(lists)))
            np.add.at(total, np.fromiter(chain.from_iterable(lists), np.int64, len(times)), times)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(total[ids])], names=["id", "n"])

    got = counts.mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").limit(n).collect()
    return [(r["id"], r["n"]) for r in got]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _coded_ids(texts: pa.Array, sub: Subwords) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: what ``coded`` tells; the distinct words' logs; the ids of all words, and where each text's end."""
    words, codes, sizes = coded(texts)
    flat, lens, logs = sub.of(words)
    many = lens[codes]
    ends = np.r_[0, np.cumsum(many)][np.cumsum(sizes)]
    return words, codes, sizes, logs, flat[_ranges((np.cumsum(lens) - lens)[codes], many)], ends


def _cut(ids: np.ndarray, most: int) -> Iterator[np.ndarray]:
    for k in range(0, max(1, len(ids)), most):
        yield ids[k : k + most]


def _pieces(batches: Iterator[pa.RecordBatch], sub: Subwords, most: int) -> Iterator[np.ndarray]:
    """Ids of all words of each text, in pieces of at most ``most``."""
    for b in batches:
        for texts in slices(b.column(0)):
            *_, ids, ends = _coded_ids(texts, sub)
            for text in np.split(ids, ends[:-1]):
                yield from _cut(text, most)


_CODED = "doc long, learn boolean, n_tokens long, n_known long, base double, tail array<binary>, times array<int>, ids binary"


def code_texts(body: DataFrame, words: Broadcast, end_log: float) -> DataFrame:
    """Of (doc, learn, text): the ids of all words, the base over the commonest words, and all other words with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = held_subwords(*words.value)
        for b in batches:
            at = 0
            for texts in slices(b.column(2)):
                n = len(texts)
                distinct, codes, sizes, logs, ids, ends = _coded_ids(texts, sub)
                of, known = np.repeat(np.arange(n), sizes), logs[codes]
                missing = np.isnan(known)
                known[missing] = 0
                pairs, times = np.unique(of[missing] * max(1, len(distinct)) + codes[missing], return_counts=True)
                text, word = np.divmod(pairs, max(1, len(distinct)))
                offsets = pa.array(np.searchsorted(text, np.arange(n + 1)), pa.int32())
                cols = [
                    b.column(0).slice(at, n), b.column(1).slice(at, n), pa.array(sizes + 1, pa.int64()),
                    pa.array(sizes - np.bincount(of[missing], minlength=n), pa.int64()), pa.array(np.bincount(of, known, n) + end_log),
                    pa.ListArray.from_arrays(offsets, distinct.take(pa.array(word))), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32())),
                    pa.array([x.tobytes() for x in np.split(ids, ends[:-1])], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _CODED.split(", ")])
                at += n

    return body.select("doc", "learn", "text").mapInArrow(run, _CODED)


def _train(model: Model, texts: Iterator[tuple[np.ndarray, tuple[int, int]]], rate: float, step_tokens: int, steps: int | None) -> int:
    """One pass over texts with the spans of places to learn, in steps of about so many tokens; with a known number of steps the rate falls to a twentieth."""
    trainer, batch, spans, held, seen = Trainer(model, rate), [], [], 0, 0
    for ids, span in texts:
        batch.append(ids)
        spans.append(span)
        held += span[1]
        if held >= step_tokens:
            trainer.learn(batch, max(0.05, 1 - trainer.step / steps) if steps else 1.0, spans)
            seen, batch, spans, held = seen + held, [], [], 0
    if batch and held:
        trainer.learn(batch, 0.05, spans)
        seen += held
    return seen


def fit(texts: DataFrame, coded: DataFrame, common: list[tuple[int, int]], tokens: int, rows: int, tokenizer: str, **given) -> Model:
    """The model, from the (text binary) training rows and their (ids binary), the counts of all ids and of words."""
    o = SETTINGS | given
    ids, v = [i for i, _ in common], len(common) + 2
    freq = np.ones(v)
    freq[: len(ids)] += [n for _, n in common]
    freq[len(ids)] += max(0, 0.001 * sum(n for _, n in common))
    freq[v - 1] += rows
    logs = np.log(freq / freq.sum())
    step, wide, rate = o["step_tokens"], o["split_tokens"], o["rate"]

    def warm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        model, sub = Model(v, logs=logs), Subwords(tokenizer, ids, v)
        texts = [sub.ids(sub.places(words_of(t.as_py()))) for b in batches for t in b.column(0)]
        texts = [w for x in texts for w in windows(x, 256)]
        total = max(1, sum(n for _, (_, n) in texts))
        passes = min(12, max(1, round(o["warm_tokens"] / total)))
        random = np.random.default_rng(4)
        order = np.concatenate([random.permutation(len(texts)) for _ in range(passes)]) if texts else []
        _train(model, (texts[i] for i in order), rate, step, max(1, total * passes // step))
        yield pa.RecordBatch.from_arrays([pa.array([model.pack().tobytes()], pa.binary())], names=["p"])

    # about 2.4 subwords in a word
    some = min(1.0, o["warm_tokens"] / 2.4 / max(1, tokens))
    sample = texts.where(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 20)) < int(some * (1 << 20)))
    start = sample.repartition(1).mapInArrow(warm, "p binary").collect()
    first = start[0]["p"] if start else Model(v, logs=logs).pack().tobytes()
    shared = texts.sparkSession.sparkContext.broadcast(first)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        flat = np.frombuffer(shared.value, np.float32)
        model = Model(v, logs=logs).unpack(flat)
        pieces = (x for b in batches for t in b.column(0) for x in _cut(np.frombuffer(t.as_buffer(), np.uint16), wide))
        n = _train(model, ((x, (0, len(x) + 1)) for x in pieces), rate / 10, wide, None)
        moved = model.pack() - flat
        cut = np.array_split(np.arange(len(moved)), 16)
        yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array([moved[c].tobytes() for c in cut], pa.binary()), pa.array([n] * 16, pa.int64())], names=["part", "p", "n"])

    def mean(group):
        n = group["n"].to_numpy(np.float64)
        total = sum(np.frombuffer(p, np.float32).astype(np.float64) * w for p, w in zip(group["p"], n, strict=True))
        out = (total / max(1.0, n.sum())).astype(np.float32).tobytes()
        return group.head(1)[["part"]].assign(p=[out], n=[int(n.sum())])

    kind = "part int, p binary, n long"
    parts = coded.mapInArrow(local, kind).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    parts = parts.groupBy("part", "salt").applyInPandas(mean, kind)  # at most a 64th of the splits in one group
    moved = {r["part"]: np.frombuffer(r["p"], np.float32) for r in parts.groupBy("part").applyInPandas(mean, kind).collect()}
    flat = np.frombuffer(first, np.float32)
    if moved:
        flat = flat + np.concatenate([moved[i] for i in sorted(moved)])
    return Model(v, logs=logs).unpack(flat)


def score(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, **given) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every row.

    A-Z are lower-cased; the tokens of a text are its words and one end.  A null text is the empty one, whose
    only token is the end.  Rows where ``learn`` is true teach; without any, the base knows no word and the
    model is what it begins as.  Repeated rows get equal scores.
    """
    o = SETTINGS | given
    spark = docs.sparkSession
    body = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"), learn.alias("learn"))
    train = body.where("learn").select("text")
    with small_batches(spark):
        counts = written(count_words(train), "words")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    rows = body.where("learn").count()
    n, v = n + rows, v + (1 if rows else 0)
    head = {bytes(r["word"]): r["c"] for r in commonest(counts, o["head_words"]).collect()}
    below = np.log10(n + 0.5 * (v + 1))
    logs = {w: float(np.log10(c + 0.5) - below) for w, c in head.items()}
    end_log = float(np.log10(rows + 0.5) - below)
    common = _commonest_ids(counts, tokenizer, o["vocabulary"] - 2)
    words = spark.sparkContext.broadcast((uuid.uuid4().hex, tokenizer, [i for i, _ in common], len(common) + 2, logs))
    with small_batches(spark):
        texts = written(code_texts(body, words, end_log).withColumn("rid", F.monotonically_increasing_id()), "coded")
        model = fit(train, texts.where("learn").select("ids"), common, n, rows, tokenizer, **given)
    shared = spark.sparkContext.broadcast(model.pack())
    width, rare = model.v, len(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        net = Model(width).unpack(shared.value)
        rare_log = float(np.log10(max(1, ALL_IDS - rare)))
        for b in batches:
            ids = [np.frombuffer(t.as_buffer(), np.uint16) for t in b.column(0)]
            scores = net.log10(ids) - np.array([np.count_nonzero(t == rare) for t in ids]) * rare_log
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(scores, pa.float64())], names=[*b.schema.names[1:], "score"])

    with small_batches(spark):
        got = texts.select("ids", "rid", "doc", "n_tokens", "n_known", "base").mapInArrow(run, "rid long, doc long, n_tokens long, n_known long, base double, score double")
        got = written(got, "scored")
    tail = texts.select("rid", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("rid", F.col("x.tail").alias("word"), F.col("x.times").alias("times"))
    tail = tail.join(counts, "word", "left").groupBy("rid").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * (F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5)) - F.lit(float(below)))).alias("more"),
    )
    all_of = got.join(tail, "rid", "left")
    return all_of.select(
        F.col("doc").alias(key),
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0)) + F.lit(1 if rows else 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )
