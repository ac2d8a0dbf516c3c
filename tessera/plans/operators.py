"""A query for each operator and function, built with this library, and the SQL that tells the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions.aggregates import aggregate, run_count, run_sum, window
from ..functions.scalar import call
from ..operators import relational as R
from ..operators import search
from ..streaming import windows
from ..streaming.ingest import AppendTable, work_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
c = F.col


def add(name: str, sql: str):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def scalar(name: str, source: str, key: str, exprs: dict[str, tuple[Callable[[], Column], str]]) -> None:
    """One projection of named expressions, made when a session is there, over a table."""
    add(name, f"select {key}, " + ", ".join(f"{sql} as {k}" for k, (_, sql) in exprs.items()) + f" from {source}")(
        lambda spark, d: table(spark, d, source).select(*[c(x.strip()) for x in key.split(",")], *[e().alias(k) for k, (e, _) in exprs.items()])
    )


# scans, filters, projections

add("scan_projection", "select l_orderkey, l_quantity from lineitem")(lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_quantity"))
add("scan_pushed_filter", "select o_orderkey, o_totalprice from orders where o_totalprice > 200000 and o_orderstatus = 'F'")(
    lambda s, d: table(s, d, "orders").where("o_totalprice > 200000 and o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
)


def _base_and_delta(s: SparkSession, d: str) -> DataFrame:
    """An append table with a base, a compacted and a fresh delta."""
    rows = table(s, d, "events").select("event_id", "value")
    t = AppendTable(s, work_folder(s, "base-and-delta"))
    t.create(rows.schema)
    t.append(rows.where("event_id < 500"), "base")
    t.append(rows.where("event_id >= 500 and event_id % 3 = 0"))
    t.append(rows.where("event_id >= 500 and event_id % 3 = 1"))
    t.compact()
    t.append(rows.where("event_id >= 500 and event_id % 3 = 2"))
    return t.read()


add("base_and_delta", "select event_id, value from events")(_base_and_delta)


def _import(s: SparkSession, d: str) -> DataFrame:
    return Engine(s).import_parquet("imported_customer", f"{d}/customer.parquet", ["c_custkey", "c_mktsegment"])


add("import_parquet", "select c_custkey, c_mktsegment from customer")(_import)
add("external_source", "select * from (values (1, 'apple', 0.5), (2, 'banana', 1.5), (null, 'cherry', 2.5)) t(a, s, d)")(
    lambda s, d: s.createDataFrame([(1, "apple", 0.5), (2, "banana", 1.5), (None, "cherry", 2.5)], "a int, s string, d double")
)
add("rename_and_reorder", "select o_custkey as customer, o_orderkey as id from orders")(lambda s, d: table(s, d, "orders").select("o_custkey", "o_orderkey").toDF("customer", "id"))

# scalar functions

scalar("fn_compare", "lineitem", "l_orderkey, l_linenumber", {
    "eq": (lambda: call("equal", c("l_returnflag"), F.lit("R")), "l_returnflag = 'R'"), "ne": (lambda: call("neq", c("l_linestatus"), F.lit("O")), "l_linestatus <> 'O'"),
    "lt": (lambda: call("lt", c("l_quantity"), F.lit(10)), "l_quantity < 10"), "lte": (lambda: call("lte", c("l_tax"), F.lit(0.04)), "l_tax <= 0.04::double"),
    "gt": (lambda: call("gt", c("l_extendedprice"), F.lit(5000)), "l_extendedprice > 5000"), "gte": (lambda: call("gte", c("l_partkey"), c("l_suppkey")), "l_partkey >= l_suppkey"),
    "bt": (lambda: call("between", c("l_quantity"), F.lit(5), F.lit(9)), "l_quantity between 5 and 9"), "isin": (lambda: call("in", c("l_linenumber"), 1, 3), "l_linenumber in (1, 3)"),
})


def _null() -> Column:
    return F.when(c("value") > 50, c("value"))


scalar("fn_logic_null", "events", "event_id", {
    "a": (lambda: call("and", _null() > 60, c("user_id") > 50), "(case when value > 50 then value end) > 60 and user_id > 50"),
    "o": (lambda: call("or", _null() > 60, c("user_id") > 50), "(case when value > 50 then value end) > 60 or user_id > 50"),
    "n": (lambda: call("not", _null() > 60), "not ((case when value > 50 then value end) > 60)"), "isn": (lambda: call("is_null", _null()), "(case when value > 50 then value end) is null"),
    "notn": (lambda: call("is_not_null", _null()), "(case when value > 50 then value end) is not null"),
    "nse": (lambda: call("is_not_distinct_from", _null(), F.lit(None).cast("double")), "(case when value > 50 then value end) is not distinct from null"),
    "co": (lambda: call("coalesce", _null(), F.lit(0.0)), "coalesce(case when value > 50 then value end, 0)"),
    "cs": (lambda: call("if_then", c("value") > 80, F.lit("high"), c("value") > 40, F.lit("mid"), F.lit("low")), "case when value > 80 then 'high' when value > 40 then 'mid' else 'low' end"),
})
scalar("fn_arithmetic", "lineitem", "l_orderkey, l_linenumber", {
    "ad": (lambda: call("add", c("l_orderkey"), c("l_partkey")), "l_orderkey + l_partkey"), "su": (lambda: call("subtract", c("l_orderkey"), c("l_suppkey")), "l_orderkey - l_suppkey"),
    "mu": (lambda: call("multiply", c("l_quantity"), c("l_extendedprice")), "l_quantity * l_extendedprice"),
    "di": (lambda: call("divide", c("l_partkey"), c("l_linenumber") - 1), "l_partkey::double / nullif(l_linenumber - 1, 0)"),
    "mo": (lambda: call("modulus", c("l_partkey"), c("l_linenumber") - 1), "l_partkey % nullif(l_linenumber - 1, 0)"),
    "ne": (lambda: call("negate", c("l_quantity")), "-l_quantity"), "ab": (lambda: call("abs", c("l_quantity") - 25), "abs(l_quantity - 25)"),
    "ro": (lambda: call("round", c("l_extendedprice")), "round(l_extendedprice)"), "fl": (lambda: call("floor", c("l_extendedprice")), "floor(l_extendedprice)"), "ce": (lambda: call("ceil", c("l_extendedprice")), "ceil(l_extendedprice)"),
})
scalar("fn_cast", "part", "p_partkey", {
    "a": (lambda: call("cast", c("p_retailprice"), "bigint"), "trunc(p_retailprice)::bigint"), "b": (lambda: call("cast", c("p_size"), "double"), "p_size::double"),
    "s": (lambda: call("cast", c("p_size"), "string"), "p_size::varchar"), "n": (lambda: call("cast", c("p_name"), "bigint"), "try_cast(p_name as bigint)"),
    "d": (lambda: call("cast", c("p_retailprice"), "decimal(18,2)"), "p_retailprice::decimal(18,2)"),
})
scalar("fn_cast_time", "orders", "o_orderkey", {
    "d": (lambda: call("cast", F.date_format("o_orderdate", "yyyy-MM-dd"), "date"), "o_orderdate::date"), "b": (lambda: call("cast", c("o_orderpriority"), "date"), "null::date"),
    "t": (lambda: call("cast", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), "timestamp_ntz"), "date_trunc('second', o_orderdate)"),
})
scalar("fn_string", "part", "p_partkey", {
    "lk": (lambda: call("like", c("p_name"), "%a_e%"), "p_name like '%a_e%'"), "st": (lambda: call("starts_with", c("p_brand"), "Brand"), "starts_with(p_brand, 'Brand')"),
    "en": (lambda: call("ends_with", c("p_name"), "e"), "ends_with(p_name, 'e')"), "ct": (lambda: call("contains", c("p_type"), "O"), "contains(p_type, 'O')"),
    "sb": (lambda: call("substring", c("p_name"), 2, 3), "substring(p_name, 2, 3)"), "s0": (lambda: call("substring", c("p_name"), 3), "substring(p_name, 3)"),
    "ln": (lambda: call("length", c("p_name")), "strlen(p_name)"), "lo": (lambda: call("lower", c("p_type")), "lower(p_type)"), "up": (lambda: call("upper", c("p_name")), "upper(p_name)"),
    "tr": (lambda: call("trim", F.concat(F.lit("  "), c("p_name"), F.lit(" "))), "trim('  ' || p_name || ' ')"), "lt": (lambda: call("ltrim", F.concat(F.lit("  "), c("p_name"))), "ltrim('  ' || p_name)"),
    "rt": (lambda: call("rtrim", F.concat(c("p_name"), F.lit("  "))), "rtrim(p_name || '  ')"), "cc": (lambda: call("concat", c("p_name"), F.lit(None).cast("string"), c("p_type")), "concat(p_name, null, p_type)"),
    "rm": (lambda: call("regexp_match", c("p_name"), "^[a-m]"), "regexp_matches(p_name, '^[a-m]')"), "rr": (lambda: call("regexp_replace", c("p_name"), "([aeiou])", "<$1>"), r"regexp_replace(p_name, '([aeiou])', '<\1>', 'g')"),
    "sp": (lambda: call("split_part", c("p_name"), " ", 2), "split_part(p_name, ' ', 2)"), "lv": (lambda: call("levenshtein", c("p_name"), c("p_type")), "levenshtein(p_name, p_type)"),
})
scalar("fn_bytes", "documents", "doc_id", {"bytes": (lambda: call("length", c("text")), "strlen(text)")})
scalar("fn_date", "orders", "o_orderkey", {
    "y": (lambda: call("year", c("o_orderdate")), "year(o_orderdate)"), "m": (lambda: call("month", c("o_orderdate")), "month(o_orderdate)"), "q": (lambda: call("extract", "QUARTER", c("o_orderdate")), "quarter(o_orderdate)"),
    "dd": (lambda: call("extract", "DAY", c("o_orderdate")), "day(o_orderdate)"), "pl": (lambda: call("date_add", c("o_orderdate").cast("date"), 30), "o_orderdate::date + 30"), "mi": (lambda: call("date_sub", c("o_orderdate").cast("date"), 7), "o_orderdate::date - 7"),
    "df": (lambda: call("date_diff", c("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")), "o_orderdate::date - date '1995-01-01'"),
    "sf": (lambda: call("strftime", c("o_orderdate"), "yyyy/MM/dd"), "strftime(o_orderdate, '%Y/%m/%d')"),
    "tm": (lambda: F.to_date(call("date_trunc", "month", c("o_orderdate"))), "date_trunc('month', o_orderdate)::date"),
    "sp": (lambda: call("strptime", F.date_format("o_orderdate", "dd.MM.yyyy"), "dd.MM.yyyy").cast("date"), "strptime(strftime(o_orderdate, '%d.%m.%Y'), '%d.%m.%Y')::date"),
})
add("fn_hash", "select count(*) as n, count(distinct p_partkey) as hashes from part")(
    lambda s, d: table(s, d, "part").select(call("hash", c("p_partkey")).alias("h")).agg(F.count("h").alias("n"), F.count_distinct("h").alias("hashes"))
)

# joins

_on = (["c_custkey"], ["o_custkey"])
_late = "o_totalprice > 300000"
_JOIN_SQL = f"from customer {{}} join (select * from orders where {_late}) o on c_custkey = o_custkey"


def _join(kind: str):
    return lambda s, d: R.join(table(s, d, "customer"), table(s, d, "orders").where(_late), kind, *_on).select("c_custkey", *([] if kind in ("semi", "anti") else ["o_orderkey"]))


for _kind in ("inner", "left", "right", "full"):
    add(f"join_{_kind}", "select c_custkey, o_orderkey " + _JOIN_SQL.format(_kind))(_join(_kind))
add("join_semi", f"select c_custkey from customer where c_custkey in (select o_custkey from orders where {_late})")(_join("semi"))
add("join_anti", f"select c_custkey from customer where not exists (select * from orders where o_custkey = c_custkey and {_late})")(_join("anti"))
add("join_multi_key", "select a.l_orderkey, a.l_linenumber, b.l_partkey as other from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber and b.l_discount > 0.09")(
    lambda s, d: R.join(
        table(s, d, "lineitem").select("l_orderkey", "l_linenumber"),
        table(s, d, "lineitem").where("l_discount > 0.09").select(c("l_orderkey").alias("k"), c("l_linenumber").alias("n"), c("l_partkey").alias("other")),
        "inner", ["l_orderkey", "l_linenumber"], ["k", "n"],
    ).drop("k", "n")
)
add("join_cross", "select n_name, r_name from nation, region")(lambda s, d: R.join(table(s, d, "nation").select("n_name"), table(s, d, "region").select("r_name"), "inner", [], []))


def _residual(s: SparkSession, d: str) -> DataFrame:
    a, b = table(s, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), table(s, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return R.inequality_join(a, b, ["s_nationkey"], ["c_nationkey"], a.s_acctbal, b.c_acctbal + 9000).select("s_suppkey", "c_custkey")


add("join_residual", "select s_suppkey, c_custkey from supplier join customer on s_nationkey = c_nationkey and s_acctbal > c_acctbal + 9000")(_residual)


def _null_safe(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "nation").select("n_name", F.when(c("n_regionkey") > 0, c("n_regionkey")).alias("a"))
    b = table(s, d, "region").select("r_name", F.when(c("r_regionkey") > 0, c("r_regionkey")).alias("b"))
    return R.join(a, b, "inner", ["a"], ["b"], null_safe=True).select("n_name", "r_name")


add("join_null_safe", "select n_name, r_name from nation join region on (case when n_regionkey > 0 then n_regionkey end) is not distinct from (case when r_regionkey > 0 then r_regionkey end)")(_null_safe)
add("join_salted", "select o_orderkey, n_name from (select o_orderkey, o_custkey % 3 as k from orders) join nation on k = n_nationkey")(
    lambda s, d: R.salted_join(table(s, d, "orders").select("o_orderkey", (c("o_custkey") % 3).cast("int").alias("k")), table(s, d, "nation").select(c("n_nationkey").alias("k"), "n_name"), "k").select("o_orderkey", "n_name")
)

# aggregates



def _by_flag(s: SparkSession, d: str):
    return table(s, d, "lineitem").groupBy("l_returnflag")


add("agg_all", "select l_returnflag, sum(l_partkey)::bigint as si, round(sum(l_tax), 4) as sf, sum(l_quantity::decimal(12,2)) as sd, count(l_tax) as n, count(*) as ns, min(l_shipdate)::date as lo, max(l_linestatus) as hi, round(avg(l_partkey), 6) as av, count(distinct l_partkey) as cd, sum(distinct l_linenumber)::bigint as sdi, median(l_quantity) as md, quantile_cont(l_quantity, 0.9) as q9, round(stddev(l_quantity), 6) as st, round(variance(l_quantity), 6) as va from lineitem group by l_returnflag")(
    lambda s, d: _by_flag(s, d).agg(
        aggregate("sum", c("l_partkey")).alias("si"), F.round(aggregate("sum", c("l_tax")), 4).alias("sf"), aggregate("sum", c("l_quantity").cast("decimal(12,2)")).alias("sd"), aggregate("count", c("l_tax")).alias("n"),
        aggregate("count_star").alias("ns"), aggregate("min", c("l_shipdate")).cast("date").alias("lo"), aggregate("max", c("l_linestatus")).alias("hi"), F.round(aggregate("avg", c("l_partkey")), 6).alias("av"),
        F.round(aggregate("stddev", c("l_quantity")), 6).alias("st"), F.round(aggregate("variance", c("l_quantity")), 6).alias("va"), aggregate("median", c("l_quantity")).alias("md"), aggregate("quantile", c("l_quantity"), 0.9).alias("q9"),
    )
    # each distinct aggregate alone: together they would multiply the rows
    .join(_by_flag(s, d).agg(aggregate("count_distinct", c("l_partkey")).alias("cd")), "l_returnflag").join(_by_flag(s, d).agg(aggregate("sum_distinct", c("l_linenumber")).alias("sdi")), "l_returnflag")
)
add("agg_avg_distinct", "select l_linestatus, round(avg(distinct l_linenumber), 6) as a, count(*) as n from lineitem group by l_linestatus")(
    lambda s, d: table(s, d, "lineitem").groupBy("l_linestatus").agg(F.round(aggregate("avg_distinct", c("l_linenumber")), 6).alias("a"), F.count("*").alias("n"))
)
add("agg_grouping_sets", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_linestatus), ())")(
    lambda s, d: R.grouping_sets(table(s, d, "lineitem"), [["l_returnflag", "l_linestatus"], ["l_linestatus"], []], ["l_returnflag", "l_linestatus"], F.count("*").alias("n"))
)
add("agg_string", "select n_regionkey, string_agg(n_name, ',' order by n_name) as names from nation group by n_regionkey")(
    lambda s, d: table(s, d, "nation").groupBy("n_regionkey").agg(aggregate("string_agg", c("n_name")).alias("names"))
)
add("agg_approx_distinct", "select event_type, count(distinct user_id) as users, true as near from events group by event_type")(
    lambda s, d: table(s, d, "events").groupBy("event_type").agg(aggregate("approx_count_distinct", c("user_id")).alias("a"), F.count_distinct("user_id").alias("b")).select("event_type", c("b").alias("users"), (F.abs(c("a") - c("b")) <= 0.2 * c("b")).alias("near"))
)
add("agg_global_empty", "select count(*) as n, sum(l_quantity) as s from lineitem where l_quantity < 0")(lambda s, d: table(s, d, "lineitem").where("l_quantity < 0").agg(aggregate("count_star").alias("n"), aggregate("sum", c("l_quantity")).alias("s")))
add("agg_null_and_expression_keys", "select case when value > 50 then event_type end as k, user_id % 10 as u, count(*) as n from events group by 1, 2")(
    lambda s, d: table(s, d, "events").groupBy(F.when(c("value") > 50, c("event_type")).alias("k"), (c("user_id") % 10).alias("u")).agg(aggregate("count_star").alias("n"))
)
add("agg_run_weighted", "select l_linestatus, sum(l_partkey * l_linenumber)::bigint as s, sum(l_linenumber)::bigint as n from lineitem group by l_linestatus")(
    lambda s, d: table(s, d, "lineitem").groupBy("l_linestatus").agg(run_sum(c("l_partkey"), c("l_linenumber")).alias("s"), run_count(c("l_partkey"), c("l_linenumber")).alias("n"))
)
add("agg_cube", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)")(lambda s, d: R.grouping(table(s, d, "lineitem"), "cube", ["l_returnflag", "l_linestatus"], F.count("*").alias("n")))
add("agg_rollup", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)")(lambda s, d: R.grouping(table(s, d, "lineitem"), "rollup", ["l_returnflag", "l_linestatus"], F.count("*").alias("n")))
add("distinct_rows", "select distinct l_returnflag, l_linenumber from lineitem")(lambda s, d: table(s, d, "lineitem").select("l_returnflag", "l_linenumber").distinct())
add("having", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 15")(lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 15"))

# windows



def _by() -> dict:
    return {"partition": ["user_id"], "order": [c("ts").asc_nulls_last(), c("event_id").asc_nulls_last()]}


_over = "over (partition by user_id order by ts, event_id rows between unbounded preceding and current row)"
_w = "over (partition by user_id order by ts, event_id)"
_whole = {"partition": ["user_id"]}
add("window_ranking", "select event_id, row_number() over (partition by user_id order by ts, event_id) as rn, rank() over (partition by user_id order by event_type) as rk, dense_rank() over (partition by user_id order by event_type) as dr from events")(
    lambda s, d: table(s, d, "events").select("event_id", window("row_number", **_by()).alias("rn"), window("rank", partition=["user_id"], order=[c("event_type")]).alias("rk"), window("dense_rank", partition=["user_id"], order=[c("event_type")]).alias("dr"))
)
add("window_lag_lead", f"select event_id, lag(value, 2) {_w} as a, lead(event_type) {_w} as b from events")(lambda s, d: table(s, d, "events").select("event_id", window("lag", c("value"), 2, **_by()).alias("a"), window("lead", c("event_type"), **_by()).alias("b")))
add("window_running", f"select event_id, round(sum(value) {_over}, 4) as s, round(avg(value) {_over}, 10) as a, min(value) {_over} as lo, max(value) {_over} as hi, count(*) {_over} as n from events")(
    lambda s, d: table(s, d, "events").select("event_id", F.round(window("sum", c("value"), **_by()), 4).alias("s"), F.round(window("avg", c("value"), **_by()), 10).alias("a"), window("min", c("value"), **_by()).alias("lo"), window("max", c("value"), **_by()).alias("hi"), window("count", **_by()).alias("n"))
)
add("window_whole", "select event_id, round(sum(value) over w, 4) as s, round(avg(value) over w, 8) as a, min(value) over w as lo, max(value) over w as hi, count(*) over w as n from events window w as (partition by user_id)")(lambda s, d: table(s, d, "events").select("event_id", F.round(window("sum", c("value"), **_whole), 4).alias("s"), F.round(window("avg", c("value"), **_whole), 8).alias("a"), window("min", c("value"), **_whole).alias("lo"), window("max", c("value"), **_whole).alias("hi"), window("count", **_whole).alias("n")))
add("window_no_partition", "select n_nationkey, row_number() over (order by n_name) as rn, count(*) over () as n from nation")(lambda s, d: table(s, d, "nation").select("n_nationkey", window("row_number", order=[c("n_name")]).alias("rn"), window("count").alias("n")))
add("window_null_key", "select event_id, count(*) over (partition by case when value > 50 then event_type end) as n from events")(lambda s, d: table(s, d, "events").select("event_id", window("count", partition=[F.when(c("value") > 50, c("event_type"))]).alias("n")))

# order, limits, exchange, set operations

add("sort_nulls_last", "select event_id, case when value > 50 then value end as v from events order by v desc nulls last, event_id limit 400")(
    lambda s, d: R.limit(R.sort(table(s, d, "events").select("event_id", F.when(c("value") > 50, c("value")).alias("v")), ("v", False), ("event_id", True)), 400)
)
add("top_k", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")(lambda s, d: R.limit(R.sort(table(s, d, "orders").select("o_orderkey", "o_totalprice"), ("o_totalprice", False), ("o_orderkey", True)), 25))
add("limit_offset", "select c_custkey from customer order by c_custkey limit 10 offset 20")(lambda s, d: R.limit(R.sort(table(s, d, "customer").select("c_custkey"), ("c_custkey", True)), 10, 20))
add("offset_only", "select c_custkey from customer order by c_custkey offset 100")(lambda s, d: R.limit(R.sort(table(s, d, "customer").select("c_custkey"), ("c_custkey", True)), None, 100))
add("exchange_hash", "select o_custkey, count(*) as n from orders group by o_custkey")(lambda s, d: R.exchange(table(s, d, "orders"), "hash", ["o_custkey"]).groupBy("o_custkey").agg(F.count("*").alias("n")))
for _kind in ("round_robin", "broadcast", "gather"):
    add(f"exchange_{_kind}", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where o_totalprice > 200000")(
        lambda s, d, kind=_kind: table(s, d, "orders").where("o_totalprice > 200000").join(R.exchange(table(s, d, "customer"), kind, partitions=6), c("o_custkey") == c("c_custkey")).select("o_orderkey", "c_name")
    )
add("exchange_partition_of", "select o_custkey, count(*) as n, 1 as parts, true as inside from orders group by o_custkey")(
    lambda s, d: table(s, d, "orders").withColumn("p", R.partition_of(["o_custkey"], 7)).groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_distinct("p").cast("int").alias("parts"), F.bool_and(c("p").between(0, 6)).alias("inside"))
)
add("exchange_split", "select o_orderkey from orders")(lambda s, d: reduce(DataFrame.union, R.split(table(s, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], 5)).select("o_orderkey"))
add("sort_ascending_nulls_last", "select event_id, case when value > 50 then value end as v from events order by v asc nulls last, event_id desc limit 900")(
    lambda s, d: R.limit(R.sort(table(s, d, "events").select("event_id", F.when(c("value") > 50, c("value")).alias("v")), ("v", True), ("event_id", False)), 900)
)
for _kind in ("union", "intersect", "except"):
    add(f"{_kind}_all", f"select c_nationkey as k from customer {_kind} all select s_nationkey from supplier")(
        lambda s, d, kind=_kind: R.set_operation(table(s, d, "customer").select(c("c_nationkey").alias("k")), table(s, d, "supplier").select("s_nationkey"), kind, True)
    )
add("union_distinct", "select n_nationkey as k from nation union select r_regionkey from region")(lambda s, d: table(s, d, "nation").select(c("n_nationkey").alias("k")).union(table(s, d, "region").select("r_regionkey")).distinct())
add("intersect", "select c_nationkey as k from customer intersect select s_nationkey from supplier")(lambda s, d: table(s, d, "customer").select(c("c_nationkey").alias("k")).intersect(table(s, d, "supplier").select("s_nationkey")))
add("except", "select n_nationkey as k from nation except select r_regionkey from region")(lambda s, d: table(s, d, "nation").select(c("n_nationkey").alias("k")).subtract(table(s, d, "region").select("r_regionkey")))

# vectors: the query vector is that of vec_id 0

_DIST = {"l2": "list_distance(e.embedding::double[], q.embedding::double[])", "inner": "-list_inner_product(e.embedding::double[], q.embedding::double[])", "cosine": "1 - list_cosine_similarity(e.embedding::double[], q.embedding::double[])"}


def _knn(metric: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        base = table(s, d, "embeddings")
        q = base.where("vec_id = 0").first()
        if q is None:
            return base.limit(0).select("vec_id", F.lit(0.0).alias("distance"))
        q = q["embedding"]
        return search.knn(base, q, 10, metric=metric).select("vec_id", F.round("distance", 5).alias("distance"))

    return run


for _m, _sql in _DIST.items():
    add(f"vector_{_m}", f"select e.vec_id, round({_sql}, 5) as distance from embeddings e, (select embedding from embeddings where vec_id = 0) q order by {_sql}, e.vec_id limit 10")(_knn(_m))
add("vector_join", f"select query, vec_id from (select q.vec_id as query, e.vec_id, row_number() over (partition by q.vec_id order by {_DIST['l2']}, e.vec_id) as n from embeddings e, embeddings q where q.vec_id % 50 = 0) where n <= 5")(
    lambda s, d: search.knn_batch(table(s, d, "embeddings"), table(s, d, "embeddings").where("vec_id % 50 = 0"), 5).select("query", "vec_id")
)

add("vector_index", f"select query, vec_id from (select q.vec_id as query, e.vec_id, row_number() over (partition by q.vec_id order by {_DIST['l2']}, e.vec_id) as n from embeddings e, embeddings q where q.vec_id % 50 = 0) where n <= 5")(
    lambda s, d: search.VectorIndex(table(s, d, "embeddings"), 16).search(table(s, d, "embeddings").where("vec_id % 50 = 0"), 5, probes=16).select("query", "vec_id")
)

# event time

add("time_tumbling", "select time_bucket(interval 1 day, ts) as window_start, event_type, count(*) as n from events group by 1, 2")(
    lambda s, d: windows.tumbling(table(s, d, "events"), "ts", "1 day", ["event_type"], F.count("*").alias("n")).select("window_start", "event_type", "n")
)
add("time_sliding", "select window_start, event_type, count(*) as n from (select unnest([time_bucket(interval 12 hour, ts), time_bucket(interval 12 hour, ts) - interval 12 hour]) as window_start, event_type from events) group by 1, 2")(
    lambda s, d: windows.tumbling(table(s, d, "events"), "ts", "1 day", ["event_type"], F.count("*").alias("n"), slide="12 hours").select("window_start", "event_type", "n")
)
add("time_sessions", """
with a as (select user_id, ts, case when ts - lag(ts) over w < interval 6 hour then 0 else 1 end as b from events window w as (partition by user_id order by ts)),
g as (select user_id, ts, sum(b) over (partition by user_id order by ts rows unbounded preceding) as k from a)
select user_id, min(ts) as session_start, count(*) as n from g group by user_id, k""")(
    lambda s, d: windows.sessions(table(s, d, "events"), "ts", "6 hours", ["user_id"], F.count("*").alias("n")).select("user_id", "session_start", "n")
)
