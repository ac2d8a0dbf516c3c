"""URL filters: host and path rules, carried over redirect and canonical links to a page's aliases."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .graph import connected_components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str  # fits this host and all below it
    path: str  # begins with /

    @property
    def name(self) -> str:
        return self.host + self.path


def parse_rule(text: str) -> Rule:
    """``block com/en/`` to a rule."""
    verdict, _, rest = text.partition(" ")
    host, slash, path = rest.partition("/")
    if verdict not in ("allow", "block") or not slash:
        raise ValueError(f"not a rule: {text!r}")
    return Rule(verdict, host.lower(), slash + path)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to / ? # or the end, A-Z lower-cased; null or no ``://``: empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, or nulls.  Of rules of equal length and name, allow wins."""
    name = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name, r.verdict)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, r.name) if name is None else name.when(fits, r.name)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    null = F.lit(None).cast("string")
    return (null, null) if name is None else (name.otherwise(null), verdict.otherwise(null))


def node_of(url: Column) -> Column:
    """64-bit key of a url: scheme and host in lower case, no fragment.  Null or no ``://``: null."""
    scheme = F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.xxhash64(scheme, host_of(url), F.when(rest == "", "/").otherwise(rest)))


def alias_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target) urls: canonical links and immediate refreshes of the page head; relative targets are resolved."""
    tag = r"(?is)<(?:link|meta)\b[^>]*>"
    attr = lambda t, a: F.regexp_extract(t, rf"(?is)\b{a}\s*=\s*[\"']?\s*([^\"'>\s]+(?:\s*;\s*url\s*=\s*[^\"'>\s]+)?)", 1)
    tags = pages.where(F.col(html).rlike(r"(?i)canonical|http-equiv")).select(
        F.col(url).alias("source"), F.explode(F.regexp_extract_all(html, F.lit(tag), F.lit(0))).alias("tag")
    )
    canonical = F.when(F.lower(attr(F.col("tag"), "rel")) == "canonical", attr(F.col("tag"), "href"))
    refresh = F.when(
        F.lower(attr(F.col("tag"), "http-equiv")) == "refresh", F.regexp_extract("tag", r"(?is)url\s*=\s*['\"]?([^\"'>\s]+)", 1)
    )
    out = tags.select("source", F.replace(F.coalesce(canonical, refresh), F.lit("&amp;"), F.lit("&")).alias("to")).where("to <> ''")
    scheme, root = F.regexp_extract("source", r"(?s)^(.*?:)//", 1), F.regexp_extract("source", r"(?s)^(.*?://[^/?#]*)", 1)
    base = F.regexp_extract("source", r"(?s)^(.*?://[^/?#]*(?:/(?:[^?#]*/)?)?)", 1)
    target = (
        F.when(F.col("to").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(scheme, "to"))
        .when(F.col("to").startswith("/"), F.concat(root, "to"))
        .otherwise(F.concat(F.when(base.endswith("/"), base).otherwise(F.concat(base, F.lit("/"))), "to"))
    )
    return out.select("source", target.alias("target")).distinct()


def judge_urls(pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url", html: str | None = "html", links: DataFrame | None = None) -> DataFrame:
    """(key, host, path, rule, verdict) of every row.

    The rule that fits a url decides.  Where none fits, the urls that are joined to it by redirects
    (``links``: source and target urls) and by the pages' own canonical links and refreshes decide: allow if
    a rule allows any of them, else block if a rule blocks any, else allow.  A url that is null or has no
    ``://`` has no host, no path and no aliases: allow.  Repeated rows share their verdict.

    The link graph holds only urls that have a link; components are found without leaving the executors.
    """
    row = pages.select(F.col(key), F.col(url).alias("_url"))
    row = row.select(key, "_url", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    row = row.select(key, "host", "path", name.alias("rule"), verdict.alias("_own"), node_of(F.col("_url")).alias("_node"))

    edges = alias_links(pages, url, html) if html else None
    if links is not None:
        more = links.select("source", "target")
        edges = more if edges is None else edges.union(more)
    if edges is None:
        return row.select(key, "host", "path", "rule", F.coalesce("_own", F.lit("allow")).alias("verdict"))
    edges = edges.select("source", "target", node_of(F.col("source")).alias("src"), node_of(F.col("target")).alias("dst"))
    edges = written(edges.where("src is not null and dst is not null and src <> dst"), "links")
    named = edges.select(F.col("source").alias("u"), F.col("src").alias("node")).union(edges.select("target", "dst"))
    _, said = fitting_rule(host_of(F.col("u")), path_of(F.col("u")), rules)
    said = named.groupBy("node").agg(F.bool_or(said == "allow").alias("a"), F.bool_or(said == "block").alias("b"))
    linked = written(connected_components(edges.select("src", "dst")).join(said, "node"), "aliases")
    of_root = linked.groupBy("root").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))
    got = F.when(F.col("a"), "allow").when(F.col("b"), "block")
    by_node = linked.select("node", "root").join(of_root, "root").select(F.col("node").alias("_node"), got.alias("_alias"))
    by_node = written(by_node.where("_alias is not null"), "verdicts")
    out = row.join(by_node, "_node", "left")
    return out.select(key, "host", "path", "rule", F.coalesce("_own", "_alias", F.lit("allow")).alias("verdict"))
