"""Web-analytics queries in the manner of ClickBench over ``events`` and ``pages``; the text is common SQL."""

from __future__ import annotations

#: Expressions that differ by dialect: Spark first, DuckDB second.
HOST = (r"regexp_replace(url, '^https?://(?:www\\.)?([^/]+)/.*$', '$1')", r"regexp_replace(url, '^https?://(?:www\.)?([^/]+)/.*$', '\1')")
K = ("cast(get_json_object(props, '$.k') as bigint)", "cast(json_extract_string(props, '$.k') as bigint)")

SQL = {
    "click_q0": "select count(*) as n from events",
    "click_q1": "select count(*) as n from events where event_type <> 'view'",
    "click_q2": "select round(sum(value), 4) as s, count(*) as n, round(avg(user_id), 4) as a from events",
    "click_q3": "select round(avg(cast(user_id as double)), 4) as a from events",
    "click_q4": "select count(distinct user_id) as n from events",
    "click_q5": "select count(distinct event_type) as n from events",
    "click_q6": "select min(cast(ts as date)) as lo, max(cast(ts as date)) as hi from events",
    "click_q7": "select event_type, count(*) as n from events where event_type <> 'view' group by event_type",
    "click_q8": "select event_type, count(distinct user_id) as u from events group by event_type order by u desc, event_type limit 10",
    "click_q9": "select user_id, round(sum(value), 4) as s, count(*) as c, round(avg(value), 4) as a, count(distinct event_type) as t from events group by user_id order by c desc, user_id limit 10",
    "click_q10": "select event_type, count(distinct user_id) as u from events where value > 0 group by event_type order by u desc, event_type limit 10",
    "click_q11": "select event_type, cast(day(ts) as bigint) as d, count(distinct user_id) as u from events group by event_type, day(ts) order by u desc, event_type, d limit 10",
    "click_q12": "select props, count(*) as c from events where props <> '' group by props order by c desc, props limit 10",
    "click_q13": "select props, count(distinct user_id) as u from events where props <> '' group by props order by u desc, props limit 10",
    "click_q14": "select event_type, props, count(*) as c from events where props <> '' group by event_type, props order by c desc, event_type, props limit 10",
    "click_q15": "select user_id, count(*) as c from events group by user_id order by c desc, user_id limit 10",
    "click_q16": "select user_id, event_type, count(*) as c from events group by user_id, event_type order by c desc, user_id, event_type limit 10",
    "click_q17": "select user_id, event_type, count(*) as c from events group by user_id, event_type order by user_id, event_type limit 10",
    "click_q18": "select user_id, cast(minute(ts) as bigint) as m, event_type, count(*) as c from events group by user_id, minute(ts), event_type order by c desc, user_id, m, event_type limit 10",
    "click_q19": "select event_id, user_id from events where user_id = 42",
    "click_q20": "select count(*) as n from pages where url like '%example.net%'",
    "click_q21": "select event_type, min(props) as p, count(*) as c from events where props like '%1%' and event_type <> '' group by event_type order by c desc, event_type limit 10",
    "click_q22": "select event_type, min(props) as p, count(*) as c, count(distinct user_id) as u from events where props like '%2%' and props not like '%9%' group by event_type order by c desc, event_type limit 10",
    "click_q23": "select event_id, user_id, event_type from events where props like '%3%' order by ts, event_id limit 10",
    "click_q24": "select event_id, props from events where props <> '' order by ts, event_id limit 10",
    "click_q25": "select props from events where props <> '' order by props limit 10",
    "click_q26": "select event_id, props from events where props <> '' order by ts, props, event_id limit 10",
    "click_q27": "select source, round(avg(octet_length(encode(text))), 4) as l, count(*) as c from documents where text <> '' group by source having count(*) > 5 order by l desc, source limit 25",
    "click_q28": "select {HOST} as k, round(avg(octet_length(encode(url))), 4) as l, count(*) as c, min(url) as u from pages where url <> '' group by {HOST} having count(*) > 1 order by l desc, k limit 25",
    "click_q29": "select " + ", ".join(f"sum(l_linenumber + {i}) as s{i:02d}" for i in range(90)) + " from lineitem",
    "click_q30": "select event_type, user_id, count(*) as c, sum({K}) as k, round(avg(value), 4) as a from events where value > 0 group by event_type, user_id order by c desc, event_type, user_id limit 10",
    "click_q31": "select l_orderkey, l_linenumber, count(*) as c, round(sum(l_tax), 4) as t, round(avg(l_quantity), 4) as a from lineitem where l_discount > 0.05 group by l_orderkey, l_linenumber order by c desc, l_orderkey, l_linenumber limit 10",
    "click_q32": "select l_orderkey, l_linenumber, count(*) as c, round(sum(l_tax), 4) as t, round(avg(l_quantity), 4) as a from lineitem group by l_orderkey, l_linenumber order by c desc, l_orderkey, l_linenumber limit 10",
    "click_q33": "select url, count(*) as c from pages group by url order by c desc, url limit 10",
    "click_q34": "select 1 as one, url, count(*) as c from pages group by url order by c desc, url limit 10",
    "click_q35": "select user_id, user_id - 1 as a, user_id - 2 as b, user_id - 3 as d, count(*) as c from events group by user_id order by c desc, user_id limit 10",
    "click_q36": "select props, count(*) as v from events where event_type = 'view' and ts >= timestamp '2024-01-05 00:00:00' and ts <= timestamp '2024-01-20 00:00:00' and user_id between 10 and 90 group by props order by v desc, props limit 10",
    "click_q37": "select event_type, count(*) as v from events where user_id = 62 and ts >= timestamp '2024-01-02 00:00:00' group by event_type order by v desc, event_type limit 10",
    "click_q38": "select props, count(*) as v from events where user_id = 62 group by props order by v desc, props limit 10 offset 5",
    "click_q39": "select event_type, case when value > 50 then props else '' end as src, user_id, count(*) as v from events where user_id < 5 group by event_type, case when value > 50 then props else '' end, user_id order by v desc, event_type, src, user_id limit 10 offset 5",
    "click_q40": "select {K} as k, cast(ts as date) as d, count(*) as v from events where {K} in (1, 6) group by {K}, cast(ts as date) order by v desc, k, d limit 10 offset 2",
    "click_q41": "select cast(value / 10 as bigint) as w, event_type, count(*) as v from events where user_id = 62 and value = floor(value / 10) * 10 + 0 or user_id = 63 and value < 5 group by cast(value / 10 as bigint), event_type order by v desc, w, event_type limit 10",
    "click_q42": "select date_trunc('minute', ts) as m, count(*) as v from events where user_id = 62 and ts >= timestamp '2024-01-14 00:00:00' and ts < timestamp '2024-01-16 00:00:00' group by date_trunc('minute', ts) order by m limit 10",
}


def text(name: str, dialect: int) -> str:
    """The query in Spark's (0) or DuckDB's (1) dialect."""
    sql = SQL[name].replace("{HOST}", HOST[dialect]).replace("{K}", K[dialect])
    sql = sql.replace("octet_length(encode(text))", ("octet_length(text)", "strlen(text)")[dialect])
    sql = sql.replace("octet_length(encode(url))", ("octet_length(url)", "strlen(url)")[dialect])
    return sql
