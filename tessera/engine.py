"""The engine: tables by name, SQL, explain, append and compaction, metrics and export."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession

from . import capabilities as caps
from .errors import NotFoundError
from .sources import export
from .streaming.ingest import AppendTable


def scan_metrics(df: DataFrame) -> dict:
    """What the scans, shuffles and sorts of an executed plan report, summed."""
    out = {"files_scanned": 0, "bytes_scanned": 0, "rows_scanned": 0, "shuffle_bytes": 0, "spill_bytes": 0, "operators": 0}

    def walk(node) -> None:
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        if name.startswith("Reused"):
            return None
        out["operators"] += 1
        m = node.metrics()
        get = lambda k: m.apply(k).value() if m.contains(k) else 0
        if name.startswith("Scan"):
            out["files_scanned"] += get("numFiles")
            out["bytes_scanned"] += get("filesSize")
            out["rows_scanned"] += get("numOutputRows")
        out["shuffle_bytes"] += get("shuffleBytesWritten")
        out["spill_bytes"] += get("spillSize")
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return out


class Result:
    """A query's rows and its metrics; each export runs the query."""

    def __init__(self, engine: Engine, df: DataFrame, text: str):
        self.engine, self.df, self.text = engine, df, text

    def to_arrow(self):
        began = time.perf_counter()
        table = self.df.toArrow()
        seconds = time.perf_counter() - began
        scanned = scan_metrics(self.df)
        files = len(self.df.inputFiles())
        self.engine._record(self.text, seconds, table.num_rows, table.nbytes, scanned | {"files_pruned": max(0, files - scanned["files_scanned"])})
        return table

    def to_pandas(self):
        return self.to_arrow().to_pandas()

    def to_matrix(self):
        return self._timed(export.to_matrix, lambda m: (len(m), m.nbytes))

    def to_torch(self):
        return self._timed(export.to_torch, lambda t: (len(t), t.numel() * t.element_size()))

    def to_tsv(self, max_rows: int = 1000) -> str:
        return self._timed(lambda df: export.to_tsv(df, max_rows), lambda t: (t.count("\n") - 1, len(t.encode())))

    def _timed(self, run, size):
        began = time.perf_counter()
        out = run(self.df)
        self.engine._record(self.text, time.perf_counter() - began, *size(out))
        return out


class Engine:
    def __init__(self, spark: SparkSession, root: str | None = None, hourly_usd: float = 3.0):
        self.spark, self.root, self.hourly_usd = spark, root, hourly_usd
        self.tables: dict[str, AppendTable] = {}
        self.history: list[dict] = []

    def _record(self, text: str, seconds: float, rows: int, size: int, more: dict | None = None) -> None:
        said = {"query_id": len(self.history), "query": text, "wall_ms": seconds * 1000, "rows_output": rows, "bytes_output": size, "cost_usd": seconds / 3600 * self.hourly_usd}
        self.history.append(said | (more or {}))

    def metrics_json(self) -> str:
        return json.dumps(self.metrics())

    def metrics(self) -> dict:
        """Of the last query."""
        return self.history[-1] if self.history else {}

    def import_parquet(self, name: str, path: str, columns: list[str] | None = None, max_rows: int | None = None) -> DataFrame:
        """Name a Parquet table, or some columns or its first rows, where it lies; nothing is read or copied."""
        df = self.spark.read.parquet(path)
        df = df.select(*columns) if columns else df
        df = df if max_rows is None else df.limit(max_rows)
        df.createOrReplaceTempView(name)
        return df

    def external(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(name)

    def create_table(self, name: str, schema) -> AppendTable:
        table = self.tables[name] = AppendTable(self.spark, f"{self.root}/{name}")
        table.create(schema)
        self._refresh(name)
        return table

    def open_table(self, name: str) -> AppendTable:
        table = AppendTable(self.spark, f"{self.root}/{name}")
        table.manifest()
        self.tables[name] = table
        self._refresh(name)
        return table

    def _table(self, name: str) -> AppendTable:
        if name not in self.tables:
            raise NotFoundError(name)
        return self.tables[name]

    def _refresh(self, name: str) -> None:
        self.tables[name].read().createOrReplaceTempView(name)

    def append(self, name: str, df: DataFrame) -> int:
        version = self._table(name).append(df)
        self._refresh(name)
        return version

    def load(self, name: str, df: DataFrame) -> int:
        """Bulk load straight into base parts."""
        version = self._table(name).append(df, "base")
        self._refresh(name)
        return version

    def compact(self, name: str) -> int:
        version = self._table(name).compact()
        self._refresh(name)
        return version

    def drop_table(self, name: str) -> None:
        """Forget a name; an append table's files go too, so that it can be created again."""
        if not self.spark.catalog.dropTempView(name):
            raise NotFoundError(name)
        if table := self.tables.pop(name, None):
            table.drop()

    def snapshot(self) -> dict[str, int]:
        """Append table to its newest version, for ``read(version)`` later on."""
        return {name: table.versions()[-1] for name, table in sorted(self.tables.items())}

    def list_tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables() if t.isTemporary)

    def has_table(self, name: str) -> bool:
        return self.spark.catalog.tableExists(name)

    def table_schema(self, name: str):
        if not self.has_table(name):
            raise NotFoundError(name)
        return self.spark.table(name).schema

    def query(self, sql: str) -> Result:
        return Result(self, self.spark.sql(sql), sql)

    def explain(self, sql: str) -> str:
        return self.spark.sql(f"EXPLAIN FORMATTED {sql}").first()[0]

    def capabilities(self) -> DataFrame:
        return caps.listing(self.spark)
