"""URL filters with redirect equivalence.

Every URL is judged by the longest rule that fits its host (or a parent domain) and path. URLs joined
by a redirect or a canonical link are aliases; over these edges connected components are computed,
and a page without a rule of its own takes its component's decision: allow if any alias is explicitly
allowed, else block if any alias is blocked, else allow.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and has no
aliases; a rule's path must be a prefix of the url's path as written, so a url with an empty path fits
no rule; of rules of one length and text an allow wins; hrefs that are empty or have a scheme other
than http(s) make no edge; repeated rows are judged each. Extra columns of the pages are kept out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from emberwatch.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_AFTER = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
_REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
_TO = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _AFTER, 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _AFTER, 2), F.lit(""))


def node(url: Column) -> Column:
    """What aliases are compared by: host, path and query, without scheme and fragment; null if no host."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host(url) != "", F.concat(host(url), F.when(rest == "", F.lit("/")).otherwise(rest)))


def _resolve(base: Column, href: Column) -> Column:
    """Absolute form of a link found on the page ``base``."""
    plain = F.regexp_replace(F.trim(href), "&amp;", "&")
    return (
        F.when((plain == "") | plain.startswith("#"), F.lit(None))
        .when(plain.rlike("(?i)^https?://"), plain)
        .when(plain.rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None))
        .when(plain.startswith("//"), F.concat(F.lit("http:"), plain))
        .when(plain.startswith("/"), F.concat(F.lit("http://"), host(base), plain))
        .otherwise(F.concat(F.lit("http://"), host(base), F.regexp_replace(F.regexp_replace(path(base), r"[^/]*$", ""), "^$", "/"), plain))
    )


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): nodes joined by a canonical link or a refresh in a page; b is null where a link leads nowhere."""
    found = F.filter(
        F.array(
            F.regexp_extract(F.regexp_extract(F.col(html), _CANONICAL, 0), _HREF, 1),
            F.regexp_extract(F.regexp_extract(F.col(html), _REFRESH, 0), _TO, 1),
        ), lambda x: x != "")
    marked = pages.where(F.col(html).rlike(r"(?i)\b(canonical|refresh)\b"))
    links = marked.select(F.col(url).alias("_u"), F.explode(found).alias("_h"))
    resolved = links.select("_u", _resolve(F.col("_u"), F.col("_h")).alias("_to"))
    return resolved.select(node(F.col("_u")).alias("a"), node(F.col("_to")).alias("b"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) tuples as a table."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (distinct host, path) with the longest fitting ``rule`` and its ``own`` verdict, or nulls.

    Every host meets the rules of itself and of its parent domains in an equi-join, so the work does
    not grow with the number of rules.
    """
    r = rules.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("verdict").alias("_v"))
    labels = F.split("host", r"\.")
    up = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = urls.select("host", "path").distinct()
    fits = asked.withColumn("_h", F.explode(up)).join(r, "_h").where(F.expr("startswith(path, _p)"))
    text = F.concat("_h", "_p")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length(text).alias("n"), (F.col("_v") == "allow").alias("ok"), text.alias("rule"), F.col("_v").alias("own"))).alias("_b"))
    return urls.join(best.select("host", "path", "_b.rule", "_b.own"), ["host", "path"], "left")


def judge(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None, url: str = "url", page_id: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, component (null without aliases) of every page.

    ``edges`` (a, b: absolute urls) adds known redirects to those found in the pages.
    """
    links = alias_edges(pages, url, html)
    if edges is not None:
        links = links.unionByName(edges.select(node(F.col("a")).alias("a"), node(F.col("b")).alias("b")))
    comp = components(links)
    own = ruled(pages.select(F.col(page_id).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"), node(F.col(url)).alias("node")), rules)
    # a node's host and path are those of its url, so targets that were never crawled are judged too
    there = F.concat(F.lit("x://"), F.col("node"))
    members = ruled(comp.select("node", "component", host(there).alias("host"), path(there).alias("path")), rules)
    decided = members.groupBy("component").agg(
        F.max(F.when(F.col("own") == "allow", 2).when(F.col("own") == "block", 1).otherwise(0)).alias("_d"))
    shared = comp.join(decided, "component").select("node", "component", "_d")
    return own.join(shared, "node", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("own", F.when(F.col("_d") == 1, "block").otherwise("allow")).alias("verdict"), "component",
    )
