"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A trigram is its letters' vectors, the first rotated twice
and the second once, multiplied element by element; a text is the sum of its trigrams; a language is the sum
of its texts, each scaled to length one.  A text gets the language whose vector is nearest by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letter classes: 0 is a gap between words, 1-26 are a-z, the other letters share the rest by code point.
CLASSES = 64
UNKNOWN = "und"


@cache
def letter_classes() -> np.ndarray:
    """Code point to class for the characters that a UTF-32 text can hold; made once in a process."""
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        if not 0xD800 <= cp < 0xE000 and chr(cp).isalpha():
            table[cp] = cp - 96 if 97 <= cp <= 122 else 27 + (cp - 0xC0) % (CLASSES - 27)
    return table


class Encoder:
    """Texts to vectors; rows of trigram vectors are made when first met and kept, CLASSES ** 3 at most."""

    def __init__(self, dims: int = 1024, seed: int = 1):
        letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (CLASSES, dims))
        self.letters = [np.roll(letters, 2 - k, axis=1) for k in range(3)]
        self.classes = letter_classes()
        self.row = np.full(CLASSES**3, -1, np.int32)
        self.table = np.empty((4096, dims), np.int8)
        self.rows = 0

    def trigrams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Codes and counts of the letter trigrams; other characters are gaps, runs of which count as one."""
        s = self.classes[np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), np.uint32)].astype(np.int32)
        s = s[np.r_[True, (s[1:] != 0) | (s[:-1] != 0)]]
        if len(s) < 3:
            return s[:0], s[:0]
        return np.unique((s[:-2] * CLASSES + s[1:-1]) * CLASSES + s[2:], return_counts=True)

    def vector(self, text: str) -> np.ndarray | None:
        """The text's vector, or None if it has no letter."""
        codes, counts = self.trigrams(text)
        if not len(codes):
            return None
        new = codes[self.row[codes] < 0]
        if len(new):
            if self.rows + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.empty((max(len(new), len(self.table)), self.table.shape[1]), np.int8)])
            a, b, c = new // CLASSES**2, new // CLASSES % CLASSES, new % CLASSES
            self.table[self.rows : self.rows + len(new)] = self.letters[0][a] * self.letters[1][b] * self.letters[2][c]
            self.row[new] = np.arange(self.rows, self.rows + len(new))
            self.rows += len(new)
        total = np.zeros(self.table.shape[1], np.float32)
        for k in range(0, len(codes), 4096):
            part = slice(k, k + 4096)
            total += counts[part].astype(np.float32) @ self.table[self.row[codes[part]]].astype(np.float32)
        return total


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows_per_lang: int = 2000, languages: int = 1000, dims: int = 1024, seed: int = 1) -> dict[str, np.ndarray]:
    """Language to unit vector, from at most about ``rows_per_lang`` random rows of each of the
    ``languages`` commonest languages (bounds that are these parameters).

    Rows with null text or language teach nothing.  The languages are counted without reading texts; then
    each row is in the sample by a hash of its key and text and its language's share, so copies are drawn one
    by one.  Sums of tasks are added up on executors in two steps; the driver gets one vector for each language.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.col(key).alias("key"))
    count = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    share = F.create_map(*[F.lit(x) for k, n in count.items() for x in (k, min(1.0, rows_per_lang / n))]) if count else None
    if share is None:
        return {}
    u = F.pmod(F.xxhash64("key", "text", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(u < F.coalesce(share[F.col("lang")], F.lit(0.0))).select("text", "lang")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, total = Encoder(dims, seed), {}
        for b in batches:
            for t, k in zip(b.column(0), b.column(1), strict=True):
                if (v := enc.vector(t.as_py())) is not None and (n := float(np.sqrt(v @ v))):
                    total[k.as_py()] = total.get(k.as_py(), 0) + v / n
        yield pa.RecordBatch.from_pydict({"lang": pa.array(total, pa.string()), "v": pa.array([v.tolist() for v in total.values()], pa.list_(pa.float32()))})

    def add(group):
        return group.head(1).assign(v=[np.stack(group["v"].to_list()).sum(0, dtype=np.float64)])

    parts = sample.mapInArrow(sums, "lang string, v array<float>").select("lang", F.col("v").cast("array<double>"), F.pmod(F.spark_partition_id(), F.lit(64)).alias("salt"))
    kind = "lang string, v array<double>, salt int"
    got = parts.groupBy("lang", "salt").applyInPandas(add, kind).groupBy("lang").applyInPandas(add, kind).collect()
    total = {r["lang"]: np.array(r["v"]) for r in got}
    return {k: (v / np.sqrt(v @ v)).astype(np.float32) for k, v in sorted(total.items()) if v @ v > 0}


def predict(df: DataFrame, model: dict[str, np.ndarray], text: str = "text", dims: int = 1024, seed: int = 1) -> DataFrame:
    """All rows and columns of ``df`` but the text, plus lang_pred and score, (1 + cosine) / 2; columns named so before are replaced.

    Null text, text without a letter, or a model without languages: ``und`` with score 0.  Ties go to the
    language that sorts first.  Every row is judged alone, from its whole text.
    """
    names = list(model)
    matrix = np.stack([model[k] for k in names]) if names else np.zeros((0, dims), np.float32)
    keep = [c for c in df.columns if c != text and c.lower() not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(dims, seed)
        for b in batches:
            langs, scores = [], []
            for t in b.column(b.num_columns - 1):
                v = enc.vector(t.as_py()) if t.is_valid and names else None
                n = float(np.sqrt(v @ v)) if v is not None else 0.0
                if not n:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cos = matrix @ v / n
                k = int(np.argmax(cos))
                langs.append(names[k])
                scores.append(float(min(1.0, max(0.0, (1 + cos[k]) / 2))))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    left = df.select(*[F.col(f"`{c}`") for c in (*keep, text)])
    schema = left.drop(text).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return left.mapInArrow(run, schema)


def identify(df: DataFrame, learn: Column, text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """Predictions for all rows by a model fitted on the rows where ``learn`` is true."""
    return predict(df.drop(lang), fit(df.where(learn), text, lang, **options), text, **{k: v for k, v in options.items() if k in ("dims", "seed")})
