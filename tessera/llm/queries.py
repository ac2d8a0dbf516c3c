"""One query for each operator, over whole tables, and the SQL that tells the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, mixing, quality, scoring, sharding, simhash, substrings, urls, warc
from .common import id_crc, read_table

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [
    urls.parse_rule(r)
    for r in ("block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/")
]
#: The mixture: whole weights by level (others 1), the domains of named sources, half of all tokens, two epochs at most.
MIX_WEIGHTS = {"domain": {"books": 1, "code": 1, "web": 6}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}
MIX_DOMAINS = {"src1": "books", "src2": "books", "src3": "code"}


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(read_table(spark, sf_dir, "documents"), 40)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.score(read_table(spark, sf_dir, "documents"), id_crc("doc_id", 5) != 1)
    return out.select("doc_id", (id_crc("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leak_table(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mixture(read_table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_DOMAINS).drop("rid")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(read_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.identify(docs, id_crc("doc_id", 5) != 0)
    return out.select("doc_id", (id_crc("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_sharding, op2_simhash, op3_lm_scoring, op4_decontamination, op5_warc,
            op6_mixing, op7_url_filters, op8_quality_rules, op9_substring_dedup, op10_language_id,
        )
    }


#: Fixed values in SQL: the words of a text, and the lines that have one.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LINES = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))"

OP7_SQL = r"""
with u as (
  select page_id, case when url like '%://%' then url end as url from pages
), p as (
  select page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from u
), r(verdict, h, p, name) as (
  values ('block', 'com', '/en/', 'com/en/'), ('allow', 'example.com', '/en/7', 'example.com/en/7'),
    ('allow', 'net', '/de/', 'net/de/'), ('block', 'example.net', '/de/8', 'example.net/de/8'), ('block', 'org', '/es/', 'org/es/')
), f as (
  select page_id, host, path, name, verdict,
    row_number() over (partition by page_id order by length(name) desc nulls last) as k
  from p left join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, r.p)
)
select page_id, host, path, name as rule, coalesce(verdict, 'allow') as verdict from f where k = 1
"""

OP8_SQL = rf"""
with d as (select doc_id, text, {_WORDS} as w, {_LINES} as ls from documents),
s as (
  select doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(ls) - len(list_distinct(ls)) as n_dup_lines, len(ls) as n_lines,
    length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) as n_upper,
    length(regexp_replace(coalesce(text, ''), '[^!]', '', 'g')) as n_marks
  from d
), g as (
  select doc_id, i, list_slice(w, i, i + 7) as g from (select doc_id, w, unnest(generate_series(1, len(w) - 7)) as i from d where len(w) >= 8)
), x as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from g) where n > 1
), c as (
  select doc_id, sum(least(8, coalesce(nxt - i, 8)))::bigint as n_repeat_words
  from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from x) group by doc_id
), t as (
  select s.*, coalesce(c.n_repeat_words, 0) as n_repeat_words from s left join c using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words or 10 * n_symbols > n_words or 10 * n_upper > 6 * word_chars
    or 10 * n_marks > 5 * n_words or 10 * n_dup_lines > 4 * n_lines or word_chars < 2 * n_words or word_chars > 15 * n_words) as kept
from t
"""

#: Word sequences are compared whole; the start of every window is held against all others by value.
OP9_SQL = rf"""
with d as (select doc_id, {_WORDS} as w from documents),
g as (
  select doc_id, i, sha256(array_to_string(list_slice(w, i, i + 49), ' ')) as g
  from (select doc_id, w, unnest(generate_series(1, len(w) - 49)) as i from d where len(w) >= 50)
), m as (
  select doc_id, i from (select doc_id, i, min(doc_id) over (partition by g) as lo from g) where lo < doc_id
), e as (
  select doc_id, unnest(w) as word, generate_subscripts(w, 1) as k from d
), l as (
  select e.doc_id, e.k, e.word, max(m.i) over (partition by e.doc_id order by e.k) as top
  from e left join m on m.doc_id = e.doc_id and m.i = e.k
), s as (
  select doc_id, count(*) filter (k - top <= 49) as n_removed,
    string_agg(word, ' ' order by k) filter (top is null or k - top > 49) as kept
  from l group by doc_id
)
select d.doc_id, len(d.w) as n_words, coalesce(s.n_removed, 0) as n_removed, sha256(coalesce(s.kept, '')) as kept_sha256
from d left join s using (doc_id)
"""


def _case(level: str) -> str:
    table = MIX_WEIGHTS.get(level, {})
    return f"case {level} " + " ".join(f"when '{k}' then {v}" for k, v in table.items()) + " else 1 end" if table else "1"


def mixture_sql(share: tuple[int, int] = (1, 2), epochs: int = 2, seed: int = 17, table: str = "documents") -> str:
    """The plan of op6 by window functions over all rows."""
    tiers, above = [], "b0"
    levels = list(mixing.LEVELS)
    for i, level in enumerate(levels):
        own, part = ", ".join(levels[: i + 1]), ", ".join(levels[:i])
        over = f"partition by {part}" if part else ""
        budget = "(select b from b0)" if not i else f"(select got from t{i - 1} p where " + " and ".join(f"p.{c} = n.{c}" for c in levels[:i]) + ")"
        tiers.append(f"""n{i} as (select {own}, sum(tokens * {epochs})::double as cap, {_case(level)} as w from leaves group by {own}),
a{i} as (select n.*, {budget}::double as b from n{i} n),
c{i} as (select *, coalesce(sum(cap) over ({over} order by cap / w, w, cap, {level} rows between unbounded preceding and 1 preceding), 0) as before,
  sum(w) over ({over} order by cap / w, w, cap, {level} rows between current row and unbounded following) as rest from a{i}),
f{i} as (select *, cap / w * rest <= b - before as isfull from c{i}),
o{i} as (select *, b - sum(case when isfull then cap else 0 end) over ({over}) as remain, sum(case when isfull then 0 else w end) over ({over}) as ow from f{i}),
t{i} as (select {own}, (case when isfull then cap else least(greatest(floor(remain * w / nullif(ow, 0)), 0), cap) end)::bigint as got from o{i})""")
    same = " and ".join(f"t.{c} = r.{c}" for c in levels)
    return f"""with words as (select doc_id, lang, source, {_case_domain()} as domain, len({_WORDS}) as tokens from {table}),
r as (select * from words where tokens > 0),
leaves as (select domain, lang, source, sum(tokens) as tokens from r group by all),
b0 as (select floor(coalesce(sum(tokens), 0) * {share[0]} / {share[1]}) as b from leaves),
{", ".join(tiers)},
j as (select r.*, l.tokens as all_tokens, (t.got // l.tokens)::int as whole, t.got % l.tokens as rest from r
  join t{len(levels) - 1} t on {same} join leaves l on {same.replace("t.", "l.")}),
e as (select doc_id, tokens, domain, lang, source, unnest(generate_series(0, whole - 1))::int as epoch from j where whole > 0),
h as (select *, sum(tokens) over (partition by domain, lang, source
  order by md5('{seed}|' || whole || '|' || doc_id), tokens rows between unbounded preceding and current row) as run from j where rest > 0)
select doc_id, tokens, domain, lang, source, epoch from e
union all select doc_id, tokens, domain, lang, source, whole from h where 2 * run - tokens <= 2 * rest"""


def _case_domain() -> str:
    return "case source " + " ".join(f"when '{k}' then '{v}'" for k, v in MIX_DOMAINS.items()) + " else 'web' end"


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": mixture_sql(), "op7_url_filters": OP7_SQL, "op8_quality_rules": OP8_SQL, "op9_substring_dedup": OP9_SQL}
