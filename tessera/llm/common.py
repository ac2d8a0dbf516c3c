"""Shared helpers: the shared working folder, written tables, and word splitting."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that ends a word, as a Java regex class and as plain characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\f\r"

#: SQL that makes every space of ``{text}`` a blank; plain byte replacement is cheaper than a pattern.
_BLANKS = "{text}"
for _c in (r"\t", r"\n", r"\u000B", r"\u000C", r"\r"):
    _BLANKS = f"replace({_BLANKS}, '{_c}', ' ')"


def words_sql(text: str = "text") -> str:
    """SQL for the words of a text as an array; a null text has none."""
    return f"array_remove(split(coalesce({_BLANKS.format(text=text)}, ''), ' ', -1), '')"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a local session (one machine) may go without that setting; it then gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="shared-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


_written: list[tuple[SparkSession, str]] = []
_tables: list[tuple[SparkSession, str]] = []
_path_of: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def _remove_all() -> None:
    try:
        for spark, name in _tables:
            spark.sql(f"drop table if exists {name}")
        for spark, path in _written:
            remove(spark, path)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        return


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when Python exits."""
    if not _written:
        atexit.register(_remove_all)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for a while."""
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage so that a lost executor costs only the tasks that were running, and a result that
    several consumers read is computed once.  The shuffle files of the write go as soon as it is done.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out


def discard(*dfs: DataFrame) -> None:
    """Delete what ``written`` wrote, once no plan reads it any more."""
    for df in dfs:
        if path := _path_of.pop(df, None):
            remove(df.sparkSession, path)


class Bucketed:
    """A table of Parquet files in the shared folder, dealt into ``buckets`` by the hash of ``by`` and sorted in each.

    Joins and groups by these columns need no shuffle of it.  Rows are appended as new sorted files, which are
    never changed; ``compact`` merges the files of each bucket, again without a shuffle.
    """

    def __init__(self, spark: SparkSession, name: str, by: Sequence[str], buckets: int):
        self.spark, self.by, self.buckets, self.base = spark, list(by), buckets, name
        self.name = ""

    def _save(self, df: DataFrame, mode: str) -> None:
        out = df.write.bucketBy(self.buckets, *self.by).sortBy(*self.by).mode(mode).option("compression", "zstd").option("path", self.path)
        with (
            setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"),
            setting(self.spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"),  # else a join by more columns deals the table anew
        ):
            out.saveAsTable(self.name)

    def _new(self) -> None:
        self.path = new_path(self.spark, self.base)
        self.name = f"{self.base}_{uuid.uuid4().hex}"
        _tables.append((self.spark, self.name))

    def dealt(self, df: DataFrame) -> DataFrame:
        """``df`` shuffled as the table is."""
        return df.repartition(self.buckets, *self.by)

    def append(self, df: DataFrame) -> None:
        """Add ``df``, which should be dealt like the table, as what is joined to the table on its columns is."""
        if not self.name:
            self._new()
        self._save(df, "append")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def compact(self, rows: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
        """One file for each bucket, of what ``rows`` keeps; it must keep the dealing."""
        df, old, path = rows(self.read()), self.name, self.path
        self._new()
        with setting(self.spark, "spark.sql.sources.bucketing.autoBucketedScan.enabled", "false"):
            self._save(df, "errorifexists")
        self.spark.sql(f"drop table {old}")
        remove(self.spark, path)

    def drop(self) -> None:
        if self.name:
            self.spark.sql(f"drop table if exists {self.name}")
            remove(self.spark, self.path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it, in any case."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(col: str, mod: int) -> Column:
    """crc32 of an id written as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % mod
