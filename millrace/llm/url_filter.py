"""URL filter with redirect equivalence, in DataFrame functions alone.

A rule (host, path prefix) fits its host and all subdomains; the longest fitting rule decides a url. A url
without a rule takes the decision of its aliases: urls that redirects and canonical links connect form a
component, which is allowed if a rule allows any of its urls, else blocked if a rule blocks any, else allowed.
So an explicit allow takes precedence over blocks that arrive along links, and a url's own rule over both.

Defined results: a null url, or one without `://`, has an empty host and path, no rule and no aliases, and is
allowed. A null html has no links. Repeated rows are each judged. Links to a page itself and link targets that
no page has are fine; the latter are judged by the rules as well. Columns besides those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _parts(url: Column) -> Column:
    """(host, path, key) of a url; key is its node: host, path and query, as scheme and fragment don't tell pages
    apart, and null without a host."""
    at = F.instr(url, "://")
    return _rest_parts(F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(""))


def _rest_parts(rest: Column) -> Column:
    def split(r: Column) -> Column:
        host = F.translate(F.regexp_extract(r, r"^[^/?#]*", 0), UPPER, LOWER)
        return F.struct(host.alias("host"), F.regexp_extract(r, r"^[^/?#]*([^?#]*)", 1).alias("path"), F.regexp_extract(r, r"^[^/?#]*([^#]*)", 1).alias("tail"))

    def key(p: Column) -> Column:
        return F.struct(p["host"].alias("host"), p["path"].alias("path"), F.when(p["host"] != "", F.concat(p["host"], p["tail"])).alias("key"))

    return _let(_let(rest, split), key)


def _rule(parts: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    known = F.array(*[F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])
    fits = F.filter(known, lambda r: ((parts["host"] == r["host"]) | F.endswith(parts["host"], F.concat(F.lit("."), r["host"]))) & F.startswith(parts["path"], r["path"]))
    return _let(F.array_max(fits), lambda r: F.struct(F.concat(r["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict")))


def page_links(pages: DataFrame) -> DataFrame:
    """Edges (a, b) between url nodes, from canonical links and refresh redirects in the html."""
    marks = r"""(?is)\brel\s*=\s*["']?canonical\b|\bhttp-equiv\s*=\s*["']?refresh\b"""
    tags = F.filter(F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0)), lambda t: t.rlike(marks))
    target = F.regexp_extract("tag", r"(?is)(?:\bhref\s*=\s*[\"']?|\burl\s*=\s*[\"']?)([^\"'\s>]+)", 1)
    linked = pages.select("url", F.explode(F.when(F.col("html").rlike("(?i)canonical|refresh"), tags)).alias("tag")).select("url", target.alias("to")).where("to <> ''")
    linked = linked.withColumn("from", _parts(F.col("url"))).where("from.key IS NOT NULL")
    authority = F.regexp_extract("url", r"^[^:]*://[^/?#]*", 0)
    folder = F.regexp_extract("from.path", r"^(.*/)", 1)
    absolute = (
        F.when(F.col("to").contains("://"), F.col("to"))
        .when(F.startswith("to", F.lit("//")), F.concat(F.lit("x:"), "to"))
        .when(F.startswith("to", F.lit("/")), F.concat(authority, "to"))
        .otherwise(F.concat(authority, F.when(folder == "", "/").otherwise(folder), "to"))
    )
    edges = linked.select(F.col("from.key").alias("a"), _parts(absolute).alias("b")).select("a", F.col("b.key").alias("b"))
    return edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every page. rules: (host, path prefix, "allow" or "block").
    redirects: more edges, as urls (from_url, to_url)."""
    scratch = scratch or Scratch(pages.sparkSession, "urls")
    edges = page_links(pages)
    if redirects is not None:
        ends = redirects.select(_parts(F.col("from_url")).alias("a"), _parts(F.col("to_url")).alias("b"))
        edges = edges.unionByName(ends.select(F.col("a.key").alias("a"), F.col("b.key").alias("b")))
    edges = scratch.save(edges.distinct(), "edges")
    judged = pages.select("page_id", _parts(F.col("url")).alias("at")).withColumn("own", _rule(F.col("at"), rules))
    judged = judged.select("page_id", "at.host", "at.path", "at.key", "own.rule", "own.verdict")
    if not edges.isEmpty():
        nodes = connected_components(edges, scratch, "aliases")
        nodes = nodes.withColumn("own", _rule(_rest_parts(F.col("node")), rules))
        # "allow" sorts before "block"
        whole = nodes.groupBy("component").agg(F.min("own.verdict").alias("passed"))
        passed = nodes.join(whole, "component").where("passed IS NOT NULL").select(F.col("node").alias("key"), "passed")
        judged = judged.join(passed, "key", "left").withColumn("verdict", F.coalesce("verdict", "passed"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
