"""Quality rules as a short-circuit cascade, built-in functions only.

Every statistic is SQL over a text column and, where words are needed, an array of words.  ``let`` binds the
array once; the rules then stand in one CASE, so that a text which an early rule rejects costs nothing more.
The order comes from a sample: rejections per second of each rule, most first.  The order changes the speed
and the rule named as the reason, never which rows pass.
"""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, words_sql

_LINES = rf"filter(split(coalesce({{t}}, ''), '\n', -1), l -> rlike(l, r'[^\x20\x09-\x0D]'))"


def let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` in which ``name`` stands for ``value``, evaluated once for each row."""
    return f"transform(array({value}), {name} -> {body})[0]"


def repeat_words_sql(w: str, span: int = 8) -> str:
    """Words inside some ``span``-word window that stands twice or more in the text (a power of two).

    Windows are compared by 64-bit hashes: neighbours are hashed together, span 1 to 2 to 4 to 8.  The
    hash set of ``array_distinct`` tells whether there is any repeat; only then are windows sorted.
    """
    h, k = w, 1
    while k < span:
        h = let(f"h{k}", h, f"zip_with(slice(h{k}, 1, size(h{k}) - {k}), slice(h{k}, {k + 1}, size(h{k})), (x, y) -> xxhash64(x, y))")
        k *= 2
    same = "(i > 0 and s[greatest(i - 1, 0)].h = e.h) or (i + 1 < size(s) and s[least(i + 1, size(s) - 1)].h = e.h)"
    places = let("s", "sort_array(transform(g, (x, i) -> struct(x as h, i as p)))", f"sort_array(filter(transform(s, (e, i) -> if({same}, e.p, -1)), p -> p >= 0))")
    union = let("p", places, f"aggregate(zip_with(p, slice(p, 2, size(p)), (a, b) -> least({span}, coalesce(b - a, {span}))), 0, (n, x) -> n + x)")
    return f"if(size({w}) < {span + 1}, 0, " + let("g", h, f"if(size(array_distinct(g)) = size(g), 0, {union})") + ")"


#: Statistic to SQL over {t}, the text, and {w}, the array of its words.
STATS = {
    "n_words": "size({w})",
    "word_chars": "char_length(array_join({w}, ''))",
    "n_symbols": "regexp_count(coalesce({t}, ''), r'[#*$%&|<>]')",
    "n_dup_lines": let("ls", _LINES, "size(ls) - size(array_distinct(ls))"),
    "n_repeat_words": repeat_words_sql("{w}"),
    "n_upper": "regexp_count(coalesce({t}, ''), r'[A-Z]')",
    "n_marks": "regexp_count(coalesce({t}, ''), r'[!]')",
    "n_lines": let("ls", _LINES, "size(ls)"),
}

#: Reject if true; over statistics.  The first two are the base rules.
BASE_RULES = {
    "short": "{n_words} < 20",
    "repeats": "100 * {n_repeat_words} > 30 * {n_words}",
}
RULES = {
    "symbols": "10 * {n_symbols} > {n_words}",
    "capitals": "10 * {n_upper} > 6 * {word_chars}",
    "marks": "10 * {n_marks} > 5 * {n_words}",
    "lines": "10 * {n_dup_lines} > 4 * {n_lines}",
    "word_length": "{word_chars} < 2 * {n_words} or {word_chars} > 15 * {n_words}",
}


def inline(rule: str, text: str, words: str) -> str:
    """A rule over statistics as SQL over the text and the array of words."""
    return rule.format(**{k: "(" + v.replace("{t}", text).replace("{w}", words) + ")" for k, v in STATS.items()})


def order_rules(df: DataFrame, rules: Mapping[str, str], rows: int = 1000, repeats: int = 8, seed: int = 7) -> list[str]:
    """Names by falling rejections per second, measured on a random sample of about ``rows`` rows; ties by name.

    The sample stays dealt out as the table is.  One pass counts what each rule rejects of it.  Then each rule
    alone is evaluated ``repeats`` times on every row and timed, twice, the better time counts, and the time of a
    rule that does nothing is taken off.  An empty sample leaves the given order.
    """
    share = min(1.0, rows / max(1, df.count()))
    sample = df.sample(False, share, seed).cache()
    again = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias(fresh(df, "_again")))

    def seconds(sql: str) -> float:
        took = []
        for _ in range(2):
            began = time.perf_counter()
            again.agg(F.count_if(F.expr(sql))).first()
            took.append(time.perf_counter() - began)
        return min(took)

    try:
        sums = sample.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.expr(sql)).alias(k) for k, sql in rules.items()]).first()
        if not sums["_n"]:
            return list(rules)
        idle = seconds(f"`{sample.columns[0]}` is null")
        rate = {k: sums[k] / sums["_n"] / max(seconds(sql) - idle, 1e-3) for k, sql in rules.items()}
        return sorted(rules, key=lambda k: (-rate[k], k))
    finally:
        sample.unpersist()


def cascade_sql(rules: Mapping[str, str], order: list[str]) -> str:
    """The first rule in order that rejects, or null; later ones aren't evaluated."""
    return "CASE " + " ".join(f"WHEN coalesce({rules[k]}, false) THEN '{k}'" for k in order) + " END"


def filter_quality(df: DataFrame, text: str = "text", rules: Mapping[str, str] | None = None, reason: str | None = None) -> DataFrame:
    """Rows that no rule rejects, with their columns as they were; with ``reason``, all rows and that column.

    Null and empty texts have no words and are rejected as short.  Each row is judged alone: repeated rows
    share their fate, and an empty table stays empty.
    """
    rules = rules or BASE_RULES | RULES
    col = fresh(df, "_text")
    body = df.withColumn(col, F.col(f"`{text}`"))
    order = order_rules(body.select(col), {k: let("w", words_sql(col), inline(r, col, "w")) for k, r in rules.items()})
    verdict = F.expr(let("w", words_sql(col), cascade_sql({k: inline(r, col, "w") for k, r in rules.items()}, order)))
    return (body.withColumn(reason, verdict) if reason else body.where(verdict.isNull())).drop(col)


#: Statistics that every row gets; the others are only taken of rows that reach a rule that needs them.
TOLD = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", rules: Mapping[str, str] | None = None) -> DataFrame:
    """(key, statistics, base_failed, rejected_by, kept) for every row; see ``filter_quality`` for nulls.

    A row that fails a base rule goes through no other: its ``rejected_by`` is that base rule.
    """
    rules = RULES if rules is None else rules
    body = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    fields = ", ".join(f"cast({STATS[k].replace('{t}', '_text').replace('{w}', 'w')} as bigint) as {k}" for k in TOLD)
    order = order_rules(body.select("_text"), {k: let("w", words_sql("_text"), inline(r, "_text", "w")) for k, r in rules.items()}) if rules else []
    stats = body.select("_key", "_text", F.expr(let("w", words_sql("_text"), f"struct({fields})")).alias("s"))
    over = {k: f"s.{k}" if k in TOLD else "(" + v.replace("{t}", "_text") + ")" for k, v in STATS.items()}
    all_rules = {k: r.format(**over) for k, r in (BASE_RULES | dict(rules)).items()}
    rejected = F.expr(cascade_sql(all_rules, [*BASE_RULES, *order]))
    out = stats.select(F.col("_key").alias(key), "s.*", rejected.alias("rejected_by"))
    failed = F.coalesce(F.col("rejected_by").isin(*BASE_RULES), F.lit(False))
    return out.select(key, *TOLD, failed.alias("base_failed"), "rejected_by", F.col("rejected_by").isNull().alias("kept"))
