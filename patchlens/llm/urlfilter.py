"""URL filter by redirect equivalence.

Rules name a host and a path prefix. Redirects (``<meta http-equiv=refresh>``) and canonical links (``<link rel=canonical>``)
are edges between addresses; addresses of one connected component are aliases. Tags in comments don't count; links are resolved
against the page's ``<base href>`` if it has one, without dot segments; links of schemes without ``://`` lead nowhere. An address keeps the verdict of its own
longest rule. One that no rule fits takes its component's: allow if any alias is explicitly allowed, else block if any alias
is blocked, else allow.

Only DataFrame functions are used. The rules become one expression, so pages are judged within the scan; only edges, and
pages of addresses that have edges, are shuffled.

Nulls, empty or malformed addresses (no ``://``) have empty host and path, fit no rule, have no aliases, and are allowed.
Very long addresses and pages are read whole; repeated rows each get their row; rules of one length tie by their letters.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, with_steps
from .components import connected_components

#: (verdict, host, path prefix)
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TAG = r"(?i)<(?:link|meta)\b[^>]*>"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES, what: int | None = None) -> Column:
    """The longest rule that fits, as text (what is None) or its verdict (what is 0); null if none fits."""
    out = F.lit(None).cast("string")
    for verdict, name, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        out = F.when(fits, F.lit(verdict if what == 0 else name + prefix)).otherwise(out)
    return out


def _without_dots(path: Column) -> Column:
    """A path without its . and .. segments; most paths have none and stay as they are."""
    parts = F.split(path, "/")
    step = lambda done, x: F.when(x == "..", F.regexp_replace(done, r"/[^/]*$", "")).when(x == ".", done).otherwise(F.concat(done, F.lit("/"), x))
    folded = F.aggregate(F.slice(parts, 2, F.size(parts)), F.lit(""), step)
    return F.when(path.contains("/."), F.concat(folded, F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))).otherwise(path)


def address(url: Column) -> Column:
    """What makes an address a vertex: lower-case scheme and host, no dot segments, no fragment; null if there is no ``://``."""
    head = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    path, query = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.regexp_extract(url, r"(?s)^.*?://[^?#]*([^#]*)", 1)
    return F.when(head != "", F.concat(F.translate(head, UPPER, LOWER), _without_dots(path), query))


def _absolute(df: DataFrame, base: str, link: str, name: str) -> DataFrame:
    """df with the address that a link on the page base leads to; null if it leads nowhere."""
    df = with_steps(df, {"plain": F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))})
    df = with_steps(df, {
        "scheme": F.regexp_extract(base, r"(?s)^(.*?:)//", 1),
        "origin": F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1),
        "folder": F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1),
        "page": F.regexp_extract(base, r"(?s)^([^?#]*)", 1),
    })
    to = F.col("plain")
    target = (
        F.when((to == "") | to.startswith("#"), F.col(base))
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(to.startswith("//"), F.concat("scheme", to))
        .when(to.startswith("/"), F.concat("origin", to))
        .when(to.startswith("?"), F.concat("page", to))
        .otherwise(F.concat("folder", F.when(F.col("folder") == F.col("origin"), "/").otherwise(""), to))
    )
    return with_steps(df, {name: target}).drop("plain", "scheme", "origin", "folder", "page")


def _attribute(tag: str, name: str) -> Column:
    return F.regexp_replace(F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", 1), "[\"']", "")


def link_edges(pages: DataFrame) -> DataFrame:
    """(u, v): pages' addresses and where their redirect or canonical tags point."""
    rows = pages.select("url", "html").where(F.col("html").rlike(r"(?i)canonical|refresh") & F.col("url").contains("://"))
    rows = with_steps(rows, {"shown": F.regexp_replace("html", r"(?s)<!--.*?(?:-->|\z)", "")})
    tags = F.filter(F.regexp_extract_all("shown", F.lit(TAG), F.lit(0)), lambda t: t.rlike(r"(?i)canonical|refresh"))
    rows = rows.select("url", F.regexp_extract("shown", r"(?i)<base\b[^>]*>", 0).alias("base_tag"), F.explode(tags).alias("tag"))
    found = with_steps(rows, {"base_href": _attribute("base_tag", "href"), "rel": _attribute("tag", "rel"), "href": _attribute("tag", "href"), "equiv": _attribute("tag", "http-equiv"), "content": _attribute("tag", "content")})
    canonical = F.when(F.lower("rel").rlike(r"(^|\s)canonical(\s|$)"), F.col("href"))
    refresh = F.when(F.lower("equiv") == "refresh", F.regexp_extract("content", r"(?is)^\s*[0-9.]+\s*[;,]\s*url\s*=\s*(.*)", 1))
    found = with_steps(found, {"link": F.coalesce(canonical, refresh)}).where("link is not null and link <> ''")
    found = _absolute(found, "url", "base_href", "own_base")
    found = with_steps(found, {"base": F.coalesce("own_base", "url")})
    ends = with_steps(_absolute(found, "base", "link", "target"), {"u": address(F.col("url")), "v": address(F.col("target"))})
    return ends.select("u", "v").where("u <> v").distinct()


def alias_verdicts(edges: DataFrame, rules=RULES) -> DataFrame:
    """(node, by_alias): the verdict that an address' component gives it, for components that have any rule."""
    nodes = connected_components(edges)
    verdict = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules, 0)
    of = nodes.withColumn("verdict", verdict).groupBy("root").agg(F.max(F.col("verdict") == "allow").alias("allowed"), F.max(F.col("verdict") == "block").alias("blocked"))
    of = of.where("allowed or blocked").select("root", F.when(F.col("allowed"), "allow").otherwise("block").alias("by_alias"))
    return nodes.join(of, "root").select("node", "by_alias")


def filter_urls(pages: DataFrame, edges: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, by_alias for every row of ``pages(page_id, url)``.

    edges(u, v): pairs of equivalent addresses; by default read from the pages' ``html``.
    """
    url = F.col("url")
    judged = pages.select("page_id", "url").select("page_id", address(url).alias("node"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.withColumns({"rule": rule_of(F.col("host"), F.col("path"), rules), "own": rule_of(F.col("host"), F.col("path"), rules, 0)})
    if edges is None:
        edges = link_edges(pages)
    else:
        edges = edges.select(address(F.col("u")).alias("u"), address(F.col("v")).alias("v")).where("u <> v").distinct()
    edges = cut(edges)
    if edges.isEmpty():
        judged = judged.withColumn("by_alias", F.lit(None).cast("string"))
    else:
        judged = judged.join(alias_verdicts(edges, rules), "node", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("own", "by_alias", F.lit("allow")).alias("verdict"), "by_alias")


def _sql_rule(host: str, path: str, rules, verdict: bool) -> str:
    """The longest fitting rule as a CASE: longer ones are asked first."""
    out = []
    for kind, name, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        out.append(f"WHEN ({host} = '{name}' OR ends_with({host}, '.{name}')) AND starts_with({path}, '{prefix}') THEN '{kind if verdict else name + prefix}'")
    return f"CASE {' '.join(out)} END"


def sql(rules=RULES) -> str:
    """The query on pages, for DuckDB; components by a recursive closure."""
    host = lambda u: f"translate(coalesce(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}')"
    path = lambda u: f"coalesce(regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
    head = lambda u: f"regexp_extract({u}, '(?s)^(.*?://[^/?#]*)', 1)"
    parts = lambda u: f"string_split({path(u)}, '/')"
    folded = lambda u: f"list_reduce({parts(u)}, lambda done, x: CASE x WHEN '..' THEN regexp_replace(done, '/[^/]*$', '') WHEN '.' THEN done ELSE done || '/' || x END) || CASE WHEN {parts(u)}[-1] IN ('.', '..') THEN '/' ELSE '' END"
    tidy = lambda u: f"CASE WHEN contains({path(u)}, '/.') THEN {folded(u)} ELSE {path(u)} END"
    node = lambda u: f"CASE WHEN {head(u)} <> '' THEN translate({head(u)}, '{UPPER}', '{LOWER}') || {tidy(u)} || regexp_extract({u}, '(?s)^.*?://[^?#]*([^#]*)', 1) END"
    attribute = lambda tag, k: f"""regexp_replace(regexp_extract({tag}, '(?is)\\s{k}\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s>"'']+)', 1), '["'']', '', 'g')"""

    def absolute(base: str, link: str) -> str:
        folder = f"regexp_extract({base}, '(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)', 1)"
        return f"""CASE WHEN {link} = '' OR starts_with({link}, '#') THEN {base} WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {link} WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
            WHEN starts_with({link}, '//') THEN regexp_extract({base}, '(?s)^(.*?:)//', 1) || {link} WHEN starts_with({link}, '/') THEN {head(base)} || {link}
            WHEN starts_with({link}, '?') THEN regexp_extract({base}, '(?s)^([^?#]*)', 1) || {link} ELSE {folder} || CASE WHEN {folder} = {head(base)} THEN '/' ELSE '' END || {link} END"""

    plain = lambda link: f"replace(trim({link}), '&amp;', '&')"
    return f"""
WITH RECURSIVE shown AS (SELECT url, regexp_replace(html, '(?s)<!--.*?(?:-->|\\z)', '', 'g') AS html FROM pages WHERE contains(url, '://')),
tags AS (SELECT url, regexp_extract(html, '(?i)<base\\b[^>]*>') AS base_tag, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\\b[^>]*>')) AS tag FROM shown),
parts AS (SELECT url, {plain(attribute("base_tag", "href"))} AS base_href, {attribute("tag", "rel")} AS rel, {attribute("tag", "href")} AS href, {attribute("tag", "http-equiv")} AS equiv, {attribute("tag", "content")} AS content FROM tags),
links AS (
    SELECT url, base_href, CASE WHEN regexp_matches(lower(rel), '(^|\\s)canonical(\\s|$)') THEN href
        WHEN lower(equiv) = 'refresh' THEN regexp_extract(content, '(?is)^\\s*[0-9.]+\\s*[;,]\\s*url\\s*=\\s*(.*)', 1) END AS link
    FROM parts
),
bases AS (SELECT url, coalesce({absolute("url", "base_href")}, url) AS base, {plain("link")} AS link FROM links WHERE link <> ''),
full_links AS (SELECT url, {absolute("base", "link")} AS target FROM bases),
edges AS (SELECT DISTINCT {node("url")} AS u, {node("target")} AS v FROM full_links),
both_ways AS (SELECT u, v FROM edges WHERE u <> v UNION SELECT v, u FROM edges WHERE u <> v),
reach AS (SELECT u, u AS v FROM both_ways UNION SELECT r.u, b.v FROM reach r JOIN both_ways b ON b.u = r.v),
judged AS (SELECT u, v, {_sql_rule(host("v"), path("v"), rules, True)} AS verdict FROM reach),
alias AS (SELECT u, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' WHEN bool_or(verdict = 'block') THEN 'block' END AS by_alias FROM judged GROUP BY u),
p AS (SELECT page_id, {node("url")} AS node, {host("url")} AS host, {path("url")} AS path FROM pages)
SELECT page_id, host, path, {_sql_rule("host", "path", rules, False)} AS rule, coalesce({_sql_rule("host", "path", rules, True)}, by_alias, 'allow') AS verdict
FROM p LEFT JOIN alias ON alias.u = p.node
"""
