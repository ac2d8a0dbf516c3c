import datetime
import json
import time
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import capabilities
from tessera.engine import Engine
from tessera.errors import CorruptError, InvalidError, NotFoundError, NotSupportedError
from tessera.functions.aggregates import aggregate
from tessera.functions.scalar import call
from tessera.operators import relational as R
from tessera.operators import search
from tessera.plans import registry
from tessera.sources import export
from tessera.streaming import windows
from tessera.streaming.ingest import AppendTable


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path))


def test_append_is_visible_and_compaction_keeps_rows(engine, spark):
    rows = spark.range(500).selectExpr("id", "cast(id % 7 as string) as s")
    engine.create_table("t", rows.schema)
    engine.load("t", rows)
    for i in range(3):
        engine.append("t", spark.range(100).selectExpr(f"id + {1000 * (i + 1)} as id", "'x' as s"))
    assert engine.query("select count(*) as n from t").to_pandas().n[0] == 800
    before = engine.tables["t"].read()
    engine.compact("t")
    assert engine.query("select count(*) as n, count(distinct id) as d from t").to_arrow().to_pylist() == [{"n": 800, "d": 800}]
    assert before.count() == 800  # readers of the old version go on
    assert [p["kind"] for p in engine.tables["t"].manifest()["parts"]] == ["base", "base"]
    again = Engine(spark, engine.root).open_table("t")
    assert again.read().count() == 800


def test_torn_append_leaves_nothing(engine, spark):
    table = engine.create_table("u", spark.range(1).schema)
    engine.append("u", spark.range(10))
    table._write(spark.range(99), "delta", 100)  # a writer that dies before it commits
    assert table.read().count() == 10
    assert len(table.recover()) == 1 and table.read().count() == 10


def test_two_writers(engine, spark):
    table = engine.create_table("w", spark.range(1).schema)
    m = table.manifest()
    table._commit(m | {"version": 2})
    with pytest.raises(InvalidError):
        table._commit(m | {"version": 2})


def test_concurrent_writers_lose_nothing(engine, spark):
    table = engine.create_table("cw", spark.range(1).schema)
    tables = [AppendTable(spark, table.path) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: tables[i].append(spark.range(i * 10, i * 10 + 10)), range(4)))
    assert table.read().distinct().count() == 40 and table.versions() == [1, 2, 3, 4, 5]


def test_one_writer_makes_a_version(engine, spark):
    table = engine.create_table("ov", spark.range(1).schema)
    m, tables = table.manifest(), [AppendTable(spark, table.path) for _ in range(8)]

    def made(at: tuple[AppendTable, int]) -> int:
        try:
            return at[0]._commit(m | {"version": at[1]})
        except InvalidError:
            return 0

    with ThreadPoolExecutor(8) as pool:
        for v in range(2, 202):
            assert sum(x == v for x in pool.map(made, [(t, v) for t in tables])) == 1
    assert table.versions() == list(range(1, 202)) and table.manifest()["version"] == 201


def test_damage_is_found(engine, spark):
    table = engine.create_table("dm", spark.range(1).schema)
    engine.append("dm", spark.range(5000))
    assert table.damaged() == []
    part = table.manifest()["parts"][0]
    file = next(Path(table.path, part["name"]).glob("part-*"))
    data = bytearray(file.read_bytes())
    data[len(data) // 2] ^= 255
    file.write_bytes(data)
    for crc in file.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match=r"(?i)crc|checksum|corrupt"):
        table.read().agg(F.sum("id")).collect()
    file.write_bytes(data[:-20])
    assert table.damaged() == [part["name"]]
    manifest = Path(table.path, "manifests", "000000000002.json")
    manifest.write_text(manifest.read_text().replace("delta", "gamma", 1))
    for crc in manifest.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(CorruptError):
        table.manifest()


def test_drop_create_snapshot_and_budget(engine, spark):
    table = engine.create_table("dc", spark.range(1).schema)
    for i in range(4):
        engine.append("dc", spark.range(i + 1))
    at = engine.snapshot()["dc"]
    assert not table.compact_over(parts=4) and table.compact_over(parts=3) and not table.compact_over(parts=0)
    assert [p["kind"] for p in table.manifest()["parts"]] == ["base"] and table.read(at).count() == table.read().count() == 10
    stop = table.compactor(every=0.05, parts=0)
    engine.append("dc", spark.range(2))
    for _ in range(200):
        if [p["kind"] for p in table.manifest()["parts"]] == ["base", "base"]:
            break
        time.sleep(0.05)
    stop()
    assert [p["kind"] for p in table.manifest()["parts"]] == ["base", "base"] and table.read().count() == 12
    engine.drop_table("dc")
    engine.create_table("dc", spark.range(1).schema)
    assert engine.query("select * from dc").to_arrow().num_rows == 0


def test_stream_into_table(engine, spark, tmp_path):
    spark.range(40).write.parquet(str(tmp_path / "in"))
    table = engine.create_table("s", spark.range(1).schema)
    stream = spark.readStream.schema(spark.range(1).schema).parquet(str(tmp_path / "in"))
    table.sink(stream, str(tmp_path / "check")).awaitTermination()
    assert table.read().count() == 40
    table.sink(stream, str(tmp_path / "other")).awaitTermination()  # another stream whose batches have the same numbers
    assert table.read().count() == 80
    table.compact()
    (tmp_path / "check" / "commits" / "0").unlink()  # as if the writer had died before it noted the batch
    for crc in (tmp_path / "check" / "commits").glob(".0.crc"):
        crc.unlink()
    table.sink(stream, str(tmp_path / "check")).awaitTermination()
    assert table.read().count() == 80 and [p["kind"] for p in table.manifest()["parts"]] == ["base"]
    spark.range(5).write.mode("append").parquet(str(tmp_path / "in"))
    table.sink(stream, str(tmp_path / "check")).awaitTermination()
    assert table.read().count() == 85


def test_watermark_drops_what_is_late(spark, tmp_path):
    rows = lambda *minutes: spark.createDataFrame([(datetime.datetime(2024, 1, 1, 0, m), "a") for m in minutes], "ts timestamp, k string")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("ts timestamp, k string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = windows.tumbling(stream, "ts", "10 minutes", ["k"], F.count("*").alias("n"), late="5 minutes")
    got = []
    for minutes in ((1, 2, 12), (31,), (3, 32), (50,)):  # minute 3 comes when its window is closed
        rows(*minutes).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = out.writeStream.outputMode("append").foreachBatch(lambda df, i: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted((r.window_start.minute, r.n) for r in got) == [(0, 2), (10, 1), (30, 2)]


def test_catalog_and_errors(engine, spark):
    engine.external("e", spark.range(3))
    assert engine.has_table("e") and "e" in engine.list_tables()
    engine.drop_table("e")
    for f in (lambda: engine.drop_table("e"), lambda: engine.table_schema("e"), lambda: engine.append("e", spark.range(1)), lambda: AppendTable(spark, engine.root + "/no").read()):
        with pytest.raises(NotFoundError):
            f()
    with pytest.raises(NotSupportedError):
        call("nope", F.lit(1))
    with pytest.raises(NotSupportedError):
        aggregate("nope")
    with pytest.raises(InvalidError):
        R.join(spark.range(1), spark.range(1), "sideways", [], [])


def test_metrics_explain_and_export(engine, spark):
    r = engine.query("select 1.5D as a, array(1.0D, 2.0D) as v, cast(null as int) as n")
    assert r.to_tsv() == "a\tv\tn\n1.5\t[1.0, 2.0]\tNULL\n"
    r.to_arrow()
    assert engine.metrics()["rows_output"] == 1 and engine.metrics()["cost_usd"] > 0
    assert "Physical Plan" in engine.explain("select 1")
    assert np.array_equal(engine.query("select 1.5D as a, array(1.0D, 2.0D) as v").to_matrix(), [[1.5, 1.0, 2.0]])
    for bad in ("select 'x' as s", "select cast(null as int) as n"):
        with pytest.raises(InvalidError):
            engine.query(bad).to_matrix()


def test_scan_metrics(engine, spark, sf):
    engine.import_parquet("li", f"{sf}/lineitem.parquet", max_rows=None)
    n = engine.query("select l_orderkey, count(*) as n from li where l_quantity > 10 group by l_orderkey").to_arrow().num_rows
    m = engine.metrics()
    assert m["rows_output"] == n and m["files_scanned"] == 1 and m["files_pruned"] == 0 and m["rows_scanned"] > n and m["shuffle_bytes"] > 0 and m["bytes_scanned"] > 0
    assert json.loads(engine.metrics_json())["query_id"] == m["query_id"]
    assert engine.import_parquet("few", f"{sf}/lineitem.parquet", ["l_tax"], 7).collect() and engine.query("select * from few").to_tsv().count("\n") == 8


def test_arrow_and_matrix_import(spark):
    import pyarrow as pa

    assert export.from_arrow(spark, pa.table({"a": [1, None], "s": ["x", "y"]})).collect() == [(1, "x"), (None, "y")]
    a = np.arange(6.0).reshape(3, 2)
    assert np.array_equal(export.to_matrix(export.from_matrix(spark, a)), a)
    with pytest.raises(InvalidError):
        export.from_matrix(spark, np.arange(3))


def test_vector_index_recall(spark, sf):
    base = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = base.where("vec_id % 50 = 0")
    exact = {(r.query, r.vec_id) for r in search.knn_batch(base, asked, 10).collect()}
    index = search.VectorIndex(base, lists=32)
    assert index.table.count() == base.where("embedding is not null").count()
    found = {(r.query, r.vec_id) for r in index.search(asked, 10, probes=20).collect()}
    assert len(found & exact) >= 0.9 * len(exact)
    few = {(r.query, r.vec_id) for r in search.knn_batch(base, asked, 10, block=3, blocks=2).collect()}
    assert few == exact
    assert search.VectorIndex(base.limit(0)).search(asked, 3).count() == 0


def most_rows(df):
    """The most rows that a step of a plan makes, once it has run."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    found = []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        found.extend(node.metrics().apply(m).value() for m in ("numOutputRows", "shuffleRecordsWritten") if node.metrics().contains(m))
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return max(found)


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """900 short random vectors, of which many are equal or are 0."""
    x = np.random.default_rng(3).integers(-4, 5, (900, 6)).astype(np.float32)
    x[::7] = x[0]
    x[::11] = 0
    path = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def told(rows):
    return sorted(repr(tuple(r)) for r in rows)  # NaN isn't equal to itself


def all_pairs(base, asked, k, metric):
    q = asked.select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))
    near = base.where("embedding is not null").crossJoin(q.where("v is not null")).select("query", "vec_id", search.METRICS[metric](F.col("embedding"), F.col("v")).alias("distance"))
    return told(search._best(near, k, "vec_id", ["query"]).collect())


@pytest.mark.parametrize("metric", ["l2", "inner", "cosine"])
def test_vector_index_makes_no_row_for_a_pair(vectors, metric):
    asked = vectors.where("vec_id % 10 = 0")
    found = search.VectorIndex(vectors, 16).search(asked, 5, probes=16, metric=metric)
    assert most_rows(found) < 900 * 90 / 4
    assert told(found.collect()) == all_pairs(vectors, asked, 5, metric)


@pytest.mark.parametrize("metric", ["l2", "inner", "cosine"])
def test_knn_batch_makes_no_row_for_a_pair(vectors, metric):
    asked = vectors.where("vec_id % 10 = 0")
    found = search.knn_batch(vectors, asked, 5, metric=metric)
    assert most_rows(found) < 900 * 90 / 4
    assert told(found.collect()) == told(search.knn_batch(vectors, asked, 5, metric=metric, blocks=3, block=20).collect()) == all_pairs(vectors, asked, 5, metric)


@pytest.mark.parametrize("metric", ["l2", "inner", "cosine"])
def test_knn_of_odd_vectors(spark, metric):
    nan, inf, low = float("nan"), float("inf"), -0.0
    odd = [[nan, 1.0], [inf, 1.0], [-inf, inf], [None, 1.0], [None, nan], [1e200, 1e200], [1e-200, 1e-170], [0.0, low], [low, low], [1e154, 1.0], None]
    rows = odd + [[float(i % 5), float(i % 3)] for i in range(30)]
    base = spark.createDataFrame([(f"r{i * 7 % 41}", v) for i, v in enumerate(rows)], "vec_id string, embedding array<double>")
    for k in (3, 60):
        assert told(search.knn_batch(base, base, k, metric=metric).collect()) == all_pairs(base, base, k, metric)
    some = base.select("vec_id", F.expr("transform(embedding, x -> try_cast(x as int))").alias("embedding"))
    assert told(search.knn_batch(some, some, 4, metric=metric).collect()) == all_pairs(some, some, 4, metric)
    assert search.knn_batch(base.limit(0), base, 3).count() == search.knn_batch(base, base.limit(0), 3).count() == 0


def test_vector_lists_of_few_probes(vectors):
    asked = vectors.where("vec_id % 50 = 0")
    index = search.VectorIndex(vectors, 8, copies=2)
    got = index.search(asked, 4, probes=3).collect()
    probed = asked.select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"), F.explode(index._nearest(F.col("embedding"), 3)).alias("list"))
    near = index.table.join(probed, "list").select("query", "vec_id", search.METRICS["l2"](F.col("embedding"), F.col("v")).alias("distance")).distinct()
    assert told(got) == told(search._best(near, 4, "vec_id", ["query"]).collect())
    with pytest.raises(Exception, match="unequal"):
        index.search(asked.select("vec_id", F.slice("embedding", 1, 2).alias("embedding")), 3).collect()


def test_join_residual_deals_a_key_and_compares_what_fits(spark, tmp_path):
    spark.range(3000).selectExpr("id as s_suppkey", "cast(id % 2 as int) as s_nationkey", "cast(id * 7919 % 3000 as double) * 4 - 1000 as s_acctbal").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(20000).selectExpr("id as c_custkey", "cast(id % 2 as int) as c_nationkey", "cast(id * 7919 % 20000 as double) - 1000 as c_acctbal").write.parquet(str(tmp_path / "customer.parquet"))
    found = registry.queries()["join_residual"](spark, str(tmp_path))
    a, b = (spark.read.parquet(str(tmp_path / f"{x}.parquet")) for x in ("supplier", "customer"))
    wanted = R.join(a, b, "inner", ["s_nationkey"], ["c_nationkey"], residual=a.s_acctbal > b.c_acctbal + 9000).select("s_suppkey", "c_custkey")
    assert found.count() == wanted.count() > 0 and found.exceptAll(wanted).count() == 0
    plan = registry.queries()["join_residual"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "_chunk" in plan and "_step" in plan  # a nation's rows aren't one task's


@pytest.mark.parametrize(("rows", "pairs"), [(256, 1 << 24), (8, 600), (1, 900)])
def test_inequality_join(spark, rows, pairs):
    odd = "case when id % 37 = 0 then null when id % 41 = 0 then cast('NaN' as double) when id % 43 = 0 then cast('-Infinity' as double) else"
    a = spark.range(300).selectExpr("case when id % 29 > 0 then cast(id % 3 as int) end as k", "id as n", f"{odd} cast(id * 17 % 50 as double) end as x", "map('n', id) as m")
    b = spark.range(200).selectExpr("case when id % 31 > 0 then id % 4 end as k", "id as n", f"{odd} cast(id * 13 % 70 as double) end as x")
    l, r = a.select(*[F.col(x).alias(f"l{x}") for x in a.columns]), b.select(*[F.col(x).alias(f"r{x}") for x in b.columns])
    wanted = l.join(r, (l.lk == r.rk) & (l.lx > r.rx + 5))
    found = R.inequality_join(a, b, ["k"], ["k"], a.x, b.x + 5, rows=rows, pairs=pairs)
    assert found.columns == ["k", "n", "x", "m", "k", "n", "x"] and [t for _, t in found.dtypes] == [t for _, t in wanted.dtypes]
    assert told(found.collect()) == told(wanted.collect())
    assert R.inequality_join(a.where("n < 0"), b, ["k"], ["k"], a.x, b.x).count() == 0
    with pytest.raises(InvalidError):
        R.inequality_join(a, b, [], [], a.x, b.x)


def test_views_of_the_user_stay(spark, sf):
    spark.range(3).createOrReplaceTempView("orders")
    registry.queries()["tpch_q4"](spark, sf).collect()
    assert spark.table("orders").count() == 3
    spark.catalog.dropTempView("orders")


def test_capabilities(spark, tmp_path):
    known = capabilities.capabilities()
    assert known["type:null"] == "unsupported" and known["type:uint32"] == "composed"
    assert capabilities.gaps(["type:null", "fn:unheard_of", "fn:add"]) == {"type:null": "no type of Spark's holds it", "fn:unheard_of": "unknown name"}
    capabilities.save(str(tmp_path / "c.tsv"))
    assert capabilities.load(str(tmp_path / "c.tsv")) == known
    assert known["join:full"] == "native" and capabilities.level(["rel:read", "fn:concat"]) == "composed"
    assert capabilities.level(["fn:unheard_of"]) == "unsupported"
    assert capabilities.listing(spark).count() == len(known)


def test_null_semantics(spark):
    df = spark.sql("select cast(null as boolean) as n, 0 as z, '12abc' as t, 2.5D as h, 'a\\\\b' as b")
    row = df.select(
        call("and", F.col("n"), F.lit(False)), call("or", F.col("n"), F.lit(True)), call("divide", F.lit(1), F.col("z")), call("modulus", F.lit(1), F.col("z")),
        call("cast", F.col("t"), "int"), call("round", F.col("h")), call("round", -F.col("h")), call("like", F.col("b"), "a\\%"),
    ).first()
    assert list(row) == [False, True, None, None, None, 3.0, -3.0, True]


def test_knn(spark):
    base = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 1.0]), (2, [5.0, 5.0]), (3, [0.1, 0.1]), (4, None)], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in search.knn(base, [0.0, 0.0], 2).collect()] == [0, 3]
    with pytest.raises(Exception, match="unequal"):
        search.knn(base, [0.0], 2).collect()
