"""URL rules, and their spread over redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.components import connected_components
from tidepool.llm.store import bind, written

#: (verdict, host, path): a rule fits the host and its subdomains where the path starts so.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.regexp_extract(rest, r"(?s)^[^?#]*", 0)
    host = F.regexp_extract(rest, r"(?s)^[^/]*", 0)
    path = F.substr(rest, F.length(host) + 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def best_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """``struct(size, allow, rule)`` of the longest rule that fits, else null; of equally long ones an allowing one.

    ``rules`` is a list in the program (some thousands at most), so it is part of the expression.
    """
    fits = [
        F.when(
            ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
            F.struct(F.lit(len(h + p)).alias("size"), F.lit(v == "allow").alias("allow"), F.lit(h + p).alias("rule")),
        )
        for v, h, p in rules
    ]
    return F.array_max(F.array_compact(F.array(*fits)))


def _absolute(link: Column, url: Column) -> Column:
    """A link on a page as an address without its fragment."""
    link = F.regexp_replace(F.trim(link), "(?s)#.*$", "")
    scheme = F.regexp_extract(url, r"(?s)^[^:/?#]*://", 0)
    site = F.regexp_extract(url, r"(?s)^[^:/?#]*://[^/?#]*", 0)
    page = F.regexp_extract(url, r"(?s)^[^?#]*", 0)
    folder = F.when(F.length(page) > F.length(site), F.regexp_extract(page, r"(?s)^.*/", 0)).otherwise(F.concat(site, F.lit("/")))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.regexp_replace(scheme, "//$", ""), link))
        .when(F.startswith(link, F.lit("/")), F.concat(site, link))
        .when(F.startswith(link, F.lit("?")), F.concat(page, link))
        .when(F.length(link) > 0, F.concat(folder, link))
    )


def node(url: Column) -> Column:
    """An address as a node of the alias graph: without fragment, scheme and host lower-cased, without a default port, its empty path "/"."""
    url = F.regexp_replace(url, "(?s)#.*$", "")
    scheme = F.lower(F.regexp_extract(url, r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    rest = F.regexp_replace(url, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    whole = F.concat(scheme, F.lit("://"), host, F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest)))
    return F.when(F.length(scheme) > 0, whole).otherwise(url)


#: Tags that may declare an alias, and the address in one. Each tag ends at its first ``>``, so cutting them out takes one pass, and so does each pattern within a tag:
#: it starts at the tag's start, and what it has taken of white space and digits it doesn't give back.
TAG = r"(?is)<(?:link|meta)\b[^>]*>"
CANONICAL = r"""(?is)^<link\b(?=[^>]*\brel\s*+=\s*+["']?+canonical\b)[^>]*\bhref\s*+=\s*+["']?+([^"'\s>]+)"""
REFRESH = r"""(?is)^<meta\b(?=[^>]*\bhttp-equiv\s*+=\s*+["']?+refresh\b)[^>]*\bcontent\s*+=\s*+["']?+\s*+[0-9.]*+\s*+[;,]\s*+url\s*+=\s*+["']?+([^"'\s>]+)"""


def alias_edges(pages: DataFrame) -> DataFrame:
    """``src, dst``: nodes that a page's canonical links or refreshing redirects, all of them, declare the same. A tag that never ends declares nothing."""
    html = F.col("html").cast("string")
    closed = F.substr(html, F.lit(1), F.length(html) - F.instr(F.reverse(html), ">") + 1)  # up to the last tag's end; else each start of an unclosed one would be read to the text's end
    tags = F.when(F.instr(html, ">") > 0, F.regexp_extract_all(closed, F.lit(TAG), F.lit(0)))
    links = F.transform(tags, lambda tag: F.concat(F.regexp_extract(tag, CANONICAL, 1), F.regexp_extract(tag, REFRESH, 1)))
    found = pages.select("url", F.explode(links).alias("link")).where("link <> ''").withColumn("link", F.regexp_replace("link", "&amp;", "&"))
    return found.select(node(F.col("url")).alias("src"), node(_absolute(F.col("link"), F.col("url"))).alias("dst")).where("src is not null and dst is not null").distinct()


def judge_urls(pages: DataFrame, rules: tuple = RULES, edges: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` (and ``component``: the smallest alias, if it has any) of every page.

    ``pages`` needs ``page_id, url, html``; other columns are ignored. ``edges(src, dst)`` are further redirects,
    as a crawler logs them. The verdict of the longest rule that fits a page's own address stands. The others
    take their component's: aliases are joined in connected components; a component that has an
    explicitly allowed address is allowed, else one that has a blocked address is blocked, else allowed. A null or
    malformed url has an empty host and path, fits no rule and is allowed. Repeated rows give repeated rows;
    an empty table gives none.
    """
    links = alias_edges(pages)
    if edges is not None:
        links = links.unionByName(edges.select(*[node(F.col(c)).alias(c) for c in ("src", "dst")]))
    members = connected_components(links)
    host, path = host_and_path(F.col("node"))
    ruled = members.withColumn("best", best_rule(host, path, rules))
    decided = ruled.groupBy("component").agg(F.max("best.allow").alias("allowed"), F.min("best.allow").alias("not_blocked"))
    decided = ruled.select("node", "component").join(decided, "component")
    decided = written(decided.select("node", "component", (F.coalesce("allowed", F.lit(True)) | F.coalesce("not_blocked", F.lit(True))).alias("alias_allowed")), "aliases")
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", node(F.col("url")).alias("node"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("best", bind(F.struct("host", "path"), lambda x: best_rule(x["host"], x["path"], rules)))
    rows = rows.join(decided, "node", "left")
    allow = F.coalesce("best.allow", "alias_allowed", F.lit(True))
    return rows.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.when(allow, "allow").otherwise("block").alias("verdict"), "component")
