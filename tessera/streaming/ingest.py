"""An append path: rows are visible at once, and small appends are compacted by one atomic switch.

A table is a folder with Parquet parts and numbered manifests.  A manifest names all parts of a version and the last
batch of each stream; its file is created only if there is none of that number, and readers take the highest.  So a reader sees either all of an append
or compaction or nothing of it, and a broken writer leaves parts that no manifest names.  Pages carry checksums,
which every read verifies; manifests carry the names and sizes of the parts' files and a checksum of their own.
"""

from __future__ import annotations

import atexit
import json
import math
import os
import tempfile
import threading
import time
import uuid
import zlib
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..errors import CorruptError, InvalidError, NotFoundError

#: Bytes of a compacted file, before its rows are counted.
TARGET = 128 << 20


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share, under ``spark.checkpoint.dir``, deleted when Python exits; a local session may go without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise InvalidError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
    table = AppendTable(spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")

    def drop() -> None:
        try:
            table.drop()
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return

    atexit.register(drop)
    return table.path


class AppendTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # manifests

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        found = self.versions()
        if not found:
            raise NotFoundError(self.path)
        at = found[-1] if version is None else version
        for wait in (0, 0.1, 0.4, 1.5):  # the newest may be about to be written
            time.sleep(wait)
            lines = self.spark.read.text(f"{self.path}/manifests/{at:012d}.json", wholetext=True).collect()
            text, _, crc = (lines[0][0] if lines else "").rpartition("\n")
            if text and crc == str(zlib.crc32(text.encode())):
                return json.loads(text)
        raise CorruptError(f"{self.path}: manifest {at}")

    def _commit(self, m: dict) -> int:
        """Fails if another writer made that version first."""
        text = json.dumps(m)
        data = f"{text}\n{zlib.crc32(text.encode())}".encode()
        path = self._path(f"{self.path}/manifests/{m['version']:012d}.json")
        try:
            if self._fs.getUri().getScheme() == "file":
                self._link(path.toUri().getPath(), data)
            else:
                out = self._fs.create(path, False)
                out.write(bytearray(data))
                out.close()
        except (FileExistsError, Py4JJavaError) as e:
            raise InvalidError(f"{self.path}: another writer made version {m['version']}") from e
        return m["version"]

    @staticmethod
    def _link(path: str, data: bytes) -> None:
        """Create a local file whole, or fail if there is one: Hadoop's local file system looks first and creates later, so two writers may both succeed."""
        os.makedirs(os.path.dirname(path), exist_ok=True)
        torn = f"{path}.{uuid.uuid4().hex}"
        try:
            with open(torn, "xb") as out:
                out.write(data)
            os.link(torn, path)
        finally:
            if os.path.exists(torn):
                os.unlink(torn)

    def _change(self, change: Callable[[dict], dict | None], tries: int = 20) -> int:
        """Commit what ``change`` makes of the newest manifest, anew if another writer was faster; None changes nothing."""
        for _ in range(tries):
            old = self.manifest()
            new = change(old)
            if new is None:
                return old["version"]
            try:
                return self._commit(old | new | {"version": old["version"] + 1})
            except InvalidError:
                continue
        raise InvalidError(f"{self.path}: {tries} times another writer was faster")

    def _files(self, name: str) -> dict[str, int]:
        return {f.getPath().getName(): f.getLen() for f in self._fs.listStatus(self._path(f"{self.path}/{name}")) if f.getPath().getName().startswith("part-")}

    def _write(self, df: DataFrame, kind: str, rows_per_file: int) -> dict:
        name = f"{kind}-{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", rows_per_file).option("parquet.page.write-checksum.enabled", "true").parquet(f"{self.path}/{name}")
        return {"name": name, "kind": kind, "files": self._files(name)}

    def _read(self, parts: list[dict], schema: StructType) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("parquet.page.verify-checksum.enabled", "true").parquet(*[f"{self.path}/{p['name']}" for p in parts])

    # API

    def create(self, schema) -> int:
        if self.versions():
            raise InvalidError(f"{self.path} exists")
        return self._commit({"version": 1, "parts": [], "streams": {}, "schema": schema.json()})

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.manifest()["schema"]))

    def append(self, df: DataFrame, kind: str = "delta", rows_per_file: int = 5_000_000, stream: tuple[str, int] | None = None) -> int:
        """The version from which on the rows are visible, once this returns; a stream's batch that is in already changes nothing."""
        schema = self.schema()
        if sorted(df.columns) != sorted(schema.names):
            raise InvalidError(f"columns {df.columns} aren't {schema.names}")
        part = self._write(df.select(*[df[f.name].cast(f.dataType) for f in schema]), kind, rows_per_file)

        def add(m: dict) -> dict | None:
            if not stream:
                return {"parts": [*m["parts"], part]}
            if m["streams"].get(stream[0], -1) >= stream[1]:
                return None
            return {"parts": [*m["parts"], part], "streams": m["streams"] | {stream[0]: stream[1]}}

        return self._change(add)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default; damaged pages are an error."""
        m = self.manifest(version)
        return self._read(m["parts"], StructType.fromJson(json.loads(m["schema"])))

    def damaged(self) -> list[str]:
        """Parts whose files aren't those that were written, by name and size."""
        return [p["name"] for p in self.manifest()["parts"] if not self._fs.exists(self._path(f"{self.path}/{p['name']}")) or self._files(p["name"]) != p["files"]]

    def compact(self, rows_per_file: int = 5_000_000) -> int:
        """Put all deltas into one base part, of as many files as their size asks for; what is appended meanwhile stays."""
        m = self.manifest()
        deltas = [p for p in m["parts"] if p["kind"] == "delta"]
        if not deltas:
            return m["version"]
        size = sum(n for p in deltas for n in p["files"].values())
        df = self._read(deltas, StructType.fromJson(json.loads(m["schema"])))
        part = self._write(df.coalesce(max(1, math.ceil(size / TARGET))), "base", rows_per_file)
        gone = {p["name"] for p in deltas}

        def swap(now: dict) -> dict:
            if not gone <= {p["name"] for p in now["parts"]}:
                raise InvalidError(f"{self.path}: another compaction was faster")
            return {"parts": [*[p for p in now["parts"] if p["name"] not in gone], part]}

        return self._change(swap)

    def compact_over(self, parts: int = 16, size: int = 1 << 30) -> bool:
        """Compact if there are more deltas, or more bytes of them, than this."""
        deltas = [p for p in self.manifest()["parts"] if p["kind"] == "delta"]
        if len(deltas) <= parts and sum(n for p in deltas for n in p["files"].values()) <= size:
            return False
        self.compact()
        return True

    def compactor(self, every: float = 1.0, parts: int = 16, size: int = 1 << 30) -> Callable[[], None]:
        """Watch the deltas in the background; call what is returned to stop."""
        stop = threading.Event()

        def watch() -> None:
            while not stop.wait(every):
                try:
                    self.compact_over(parts, size)
                except InvalidError:  # another one was faster
                    continue

        thread = threading.Thread(target=watch, daemon=True)
        thread.start()
        return lambda: (stop.set(), thread.join())[1]

    def recover(self, older_than: float = 0) -> list[str]:
        """Delete parts that no version names and that are at least so many seconds old; returns them.

        With 0 only while no writer runs: one that hasn't committed yet would lose its part.
        """
        named = {p["name"] for v in self.versions() for p in self.manifest(v)["parts"]}
        gone = []
        for f in self._fs.listStatus(self._path(self.path)):
            name = f.getPath().getName()
            if name != "manifests" and name not in named and f.getModificationTime() / 1000 <= time.time() - older_than:
                self._fs.delete(f.getPath(), True)
                gone.append(name)
        return gone

    def drop(self) -> None:
        """Delete the table with all its versions."""
        self._fs.delete(self._path(self.path), True)

    def sink(self, stream: DataFrame, checkpoint: str, **trigger):
        """Append each micro-batch of a stream; a batch repeated after a failure is written once.

        Batches are known by the query's id, which its checkpoint keeps, and their number.
        """

        def put(df: DataFrame, batch: int) -> None:
            query = df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
            if self.manifest()["streams"].get(query, -1) < batch and not df.isEmpty():
                self.append(df, stream=(query, batch))

        return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
