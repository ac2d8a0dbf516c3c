"""TPC-H Q1-Q22 over the tables and columns at hand.

Where a column or table is missing the nearest one stands in: ship mode and priority lists become return flags
and priorities, commit dates become fixed offsets, ``partsupp`` becomes the part-supplier pairs of ``lineitem``.
The text is common SQL, so the same text serves as the oracle's.
"""

from __future__ import annotations

REV = "l_extendedprice * (1 - l_discount)"

SQL = {
    "tpch_q1": f"""
select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice), 2) as sum_base_price,
  round(sum({REV}), 2) as sum_disc_price, round(sum({REV} * (1 + l_tax)), 2) as sum_charge,
  round(avg(l_quantity), 4) as avg_qty, round(avg(l_extendedprice), 4) as avg_price, round(avg(l_discount), 6) as avg_disc, count(*) as count_order
from lineitem where l_shipdate <= timestamp '2001-09-02 00:00:00' group by l_returnflag, l_linestatus""",
    "tpch_q2": """
select s_acctbal, s_name, n_name, p_partkey, p_brand from (
  select s_acctbal, s_name, n_name, p_partkey, p_brand, l_extendedprice / l_quantity as cost, min(l_extendedprice / l_quantity) over (partition by p_partkey) as low
  from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey
  where p_size < 15 and p_type = 'PROMO' and r_name = 'EUROPE') x
where cost = low order by s_acctbal desc, n_name, s_name, p_partkey limit 100""",
    "tpch_q3": f"""
select l_orderkey, round(sum({REV}), 2) as revenue, cast(o_orderdate as date) as o_orderdate from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
where c_mktsegment = 'BUILDING' and o_orderdate < timestamp '1998-03-15 00:00:00' and l_shipdate > timestamp '1998-03-15 00:00:00'
group by l_orderkey, o_orderdate order by revenue desc, l_orderkey limit 10""",
    "tpch_q4": """
select o_orderpriority, count(*) as order_count from orders
where o_orderdate >= timestamp '1998-07-01 00:00:00' and o_orderdate < timestamp '1998-10-01 00:00:00'
  and exists (select * from lineitem where l_orderkey = o_orderkey and l_discount > 0.05) group by o_orderpriority""",
    "tpch_q5": f"""
select n_name, round(sum({REV}), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
  join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
where r_name = 'ASIA' and o_orderdate >= timestamp '1996-01-01 00:00:00' and o_orderdate < timestamp '1999-01-01 00:00:00' group by n_name""",
    "tpch_q6": """
select round(sum(l_extendedprice * l_discount), 2) as revenue from lineitem
where l_shipdate >= timestamp '1996-01-01 00:00:00' and l_shipdate < timestamp '1997-01-01 00:00:00' and l_discount between 0.045 and 0.075 and l_quantity < 24""",
    "tpch_q7": f"""
select n1.n_name as supp_nation, n2.n_name as cust_nation, cast(year(l_shipdate) as bigint) as l_year, round(sum({REV}), 2) as revenue
from supplier join lineitem on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
  join nation n1 on s_nationkey = n1.n_nationkey join nation n2 on c_nationkey = n2.n_nationkey
where n1.n_name in ('NATION_1', 'NATION_2') and n2.n_name in ('NATION_1', 'NATION_2') and n1.n_name <> n2.n_name group by n1.n_name, n2.n_name, year(l_shipdate)""",
    "tpch_q8": f"""
select o_year, round(sum(case when nation = 'NATION_2' then volume else 0 end) / sum(volume), 6) as mkt_share from (
  select cast(year(o_orderdate) as bigint) as o_year, {REV} as volume, n2.n_name as nation from part join lineitem on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey
    join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation n1 on c_nationkey = n1.n_nationkey join nation n2 on s_nationkey = n2.n_nationkey
    join region on n1.n_regionkey = r_regionkey where r_name = 'AMERICA' and p_type = 'ECONOMY') x group by o_year""",
    "tpch_q9": f"""
select n_name as nation, cast(year(o_orderdate) as bigint) as o_year, round(sum({REV} - p_retailprice * 0.1 * l_quantity), 2) as sum_profit
from part join lineitem on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey join nation on s_nationkey = n_nationkey
where p_name like '%e%' group by n_name, year(o_orderdate)""",
    "tpch_q10": f"""
select c_custkey, c_name, round(sum({REV}), 2) as revenue, c_acctbal, n_name from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
  join nation on c_nationkey = n_nationkey where o_orderdate >= timestamp '1997-10-01 00:00:00' and o_orderdate < timestamp '1998-01-01 00:00:00' and l_returnflag = 'R'
group by c_custkey, c_name, c_acctbal, n_name order by revenue desc, c_custkey limit 20""",
    "tpch_q11": """
with v as (select l_partkey, sum(l_extendedprice) as value from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey where n_regionkey = 2 group by l_partkey)
select l_partkey, round(value, 2) as value from v where value > (select avg(value) * 2 from v)""",
    "tpch_q12": """
select l_returnflag, sum(case when o_orderpriority = '1-URGENT' or o_orderpriority = '2-HIGH' then 1 else 0 end) as high_line_count,
  sum(case when o_orderpriority <> '1-URGENT' and o_orderpriority <> '2-HIGH' then 1 else 0 end) as low_line_count
from orders join lineitem on o_orderkey = l_orderkey where l_returnflag in ('A', 'R') and l_shipdate > o_orderdate
  and l_shipdate >= timestamp '1996-01-01 00:00:00' and l_shipdate < timestamp '1997-01-01 00:00:00' group by l_returnflag""",
    "tpch_q13": """
select c_count, count(*) as custdist from (
  select c_custkey, count(o_orderkey) as c_count from customer left join orders on c_custkey = o_custkey and o_orderpriority <> '5-LOW' group by c_custkey) x group by c_count""",
    "tpch_q14": f"""
select round(100.0 * sum(case when p_type like 'PROMO%' then {REV} else 0 end) / sum({REV}), 6) as promo_revenue
from lineitem join part on l_partkey = p_partkey where l_shipdate >= timestamp '1997-09-01 00:00:00' and l_shipdate < timestamp '1997-10-01 00:00:00'""",
    "tpch_q15": f"""
with r as (select l_suppkey, round(sum({REV}), 2) as total from lineitem where l_shipdate >= timestamp '1998-01-01 00:00:00' and l_shipdate < timestamp '1998-04-01 00:00:00' group by l_suppkey)
select s_suppkey, s_name, total as total_revenue from supplier join r on s_suppkey = l_suppkey where total = (select max(total) from r)""",
    "tpch_q16": """
select p_brand, p_type, p_size, count(distinct l_suppkey) as supplier_cnt from lineitem join part on p_partkey = l_partkey
where p_type not like 'MEDIUM%' and p_size in (9, 14, 19, 23, 36, 45, 49, 3) and l_suppkey not in (select s_suppkey from supplier where s_acctbal < 0) group by p_brand, p_type, p_size""",
    "tpch_q17": """
select round(sum(l_extendedprice) / 7.0, 4) as avg_yearly from lineitem join part on p_partkey = l_partkey
  join (select l_partkey as k, 0.2 * avg(l_quantity) as q from lineitem group by l_partkey) a on k = p_partkey where p_size < 20 and l_quantity < q""",
    "tpch_q18": """
select c_name, c_custkey, o_orderkey, cast(o_orderdate as date) as o_orderdate, o_totalprice, sum(l_quantity) as sum_qty
from customer join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey
where o_orderkey in (select l_orderkey from lineitem group by l_orderkey having sum(l_quantity) > 200)
group by c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice order by o_totalprice desc, o_orderkey limit 100""",
    "tpch_q19": f"""
select round(sum({REV}), 2) as revenue from lineitem join part on p_partkey = l_partkey
where (p_type = 'SMALL' and l_quantity between 1 and 11 and p_size between 1 and 5) or (p_type = 'MEDIUM' and l_quantity between 10 and 20 and p_size between 1 and 10)
  or (p_type = 'LARGE' and l_quantity between 20 and 30 and p_size between 1 and 15)""",
    "tpch_q20": """
select s_name, s_nationkey from supplier where s_suppkey in (
  select l_suppkey from lineitem where l_partkey in (select p_partkey from part where p_name like '%a%')
    and l_shipdate >= timestamp '1997-01-01 00:00:00' and l_shipdate < timestamp '1998-01-01 00:00:00' group by l_suppkey having sum(l_quantity) > 500)""",
    "tpch_q21": """
select s_name, count(*) as numwait from supplier join lineitem l1 on s_suppkey = l1.l_suppkey join orders on o_orderkey = l1.l_orderkey
where o_orderstatus = 'F' and l1.l_returnflag = 'R'
  and exists (select * from lineitem l2 where l2.l_orderkey = l1.l_orderkey and l2.l_suppkey <> l1.l_suppkey)
  and not exists (select * from lineitem l3 where l3.l_orderkey = l1.l_orderkey and l3.l_suppkey <> l1.l_suppkey and l3.l_returnflag = 'R')
group by s_name order by numwait desc, s_name limit 100""",
    "tpch_q22": """
select c_nationkey, count(*) as numcust, round(sum(c_acctbal), 2) as totacctbal from customer
where c_acctbal > (select avg(c_acctbal) from customer where c_acctbal > 0) and not exists (select * from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT' and o_orderstatus = 'F') group by c_nationkey""",
}
