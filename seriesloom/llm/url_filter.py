"""URL filters whose block decisions follow redirects and canonical links to aliases; DataFrame operations alone.

Rules name a host and the start of a path; the longest that fits a URL decides it. A URL without a rule takes the decision of its
aliases: URLs are nodes; a redirect (given as a table, or a page's meta refresh) and a canonical link are edges, and with
``spellings`` (the default) also the way from every node, pages, targets and redirects alike, to its canonical spelling (https, no
www. or m., fragment, tracking parameters, .html or trailing slash). A component that holds a URL which a rule
blocks is blocked. An explicit allow goes first: what an allow rule fits stays allowed in a blocked component. All else is allowed.

Nodes are named by MD5, so components see hashed names. Repeated URLs are one node, so a URL, host or alias that a third of all pages
share costs one row after partial aggregation; the joins back to pages can be split by AQE.

Links are resolved by RFC 3986 against the page's first ``<base>``, if it has one, else its URL, after the entities of HTML's own marks
(&amp; &lt; &gt; &quot; &#39; and those by number) are undone.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is allowed; null html has no links;
repeated rows get equal verdicts; every canonical link and refresh of a page counts, whole html being searched, however long; rules that fit with
equal length go by their text; other columns are not carried; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.components import components
from seriesloom.plans.scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PLACE = r"(?s)^.*?://([^/?#]*)([^?#]*)"
CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
TARGET = r"(?is)\burl\s*=\s*['\"]?([^\"'\s>]+)"
BASE = r"(?is)<base\b[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
#: HTML's own marks as entities; the ampersand is last, so that nothing is undone twice.
ENTITIES = [("&(?:lt|#0*60|#[xX]0*3[cC]);", "<"), ("&(?:gt|#0*62|#[xX]0*3[eE]);", ">"), ("&(?:quot|#0*34|#[xX]0*22);", '"'), ("&(?:apos|#0*39|#[xX]0*27);", "'"), ("&(?:amp|#0*38|#[xX]0*26);", "&")]
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
#: Query parameters that never change the page.
TRACKING = r"(?i)(^|&)(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PLACE, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PLACE, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule (verdict, host/path) that fits, as a struct of size, rule and verdict; null if none does."""
    fits = []
    for verdict, rule in rules:
        own, _, rest = rule.partition("/")
        hit = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")
        fits.append(F.when(hit, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size: int, rule: string, verdict: string>")


def spelling(url: Column) -> Column:
    """The canonical spelling of a URL with a host."""
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"(?:/index)?\.html?$", ""), "/+$", "")
    query = F.regexp_replace(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), TRACKING, "")
    query = F.regexp_replace(query, "^&", "")
    return F.concat(F.lit("https://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def undotted(path: Column) -> Column:
    """A path from the root without its segments "." and ".."."""
    parts = F.split(path, "/")
    back = lambda kept: F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
    add = lambda kept, x: F.when(x == "..", back(kept)).when(x == ".", kept).otherwise(F.concat(kept, F.array(x)))
    # a last segment that goes leaves the slash before it
    parts = F.concat(F.slice(parts, F.lit(2), F.size(parts)), F.when(path.rlike(r"/\.\.?$"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
    joined = F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), add), "/"))
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), joined).otherwise(path)


def resolved(link: Column, url: Column) -> Column:
    """A link's absolute URL by RFC 3986; null for none and for schemes without ``//``, as mailto."""
    scheme, base = F.regexp_extract(url, r"(?s)^(.*?)://", 1), path_of(url)
    root = F.concat(scheme, F.lit("://"), host_of(url))
    own, rest = F.regexp_extract(link, r"(?s)^[^?#]*", 0), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.when(base.startswith("/"), F.regexp_extract(base, r"(?s)^.*/", 0)).otherwise("/")
    return (
        F.when(link.rlike(f"{SCHEME}//"), link)
        .when(link.rlike(SCHEME), None)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, undotted(own), rest))
        .when(link.startswith("?"), F.concat(root, base, link))
        .when(link.startswith("#"), F.concat(F.regexp_extract(url, r"(?s)^[^#]*", 0), link))
        .otherwise(F.concat(root, undotted(F.concat(folder, own)), rest))
    )


def unescaped(link: Column) -> Column:
    """A link without entities of HTML's own marks."""
    out = link
    for entity, mark in ENTITIES:
        out = F.regexp_replace(out, entity, mark)
    return F.when(link.contains("&"), out).otherwise(link)


def links(pages: DataFrame) -> DataFrame:
    """(a, b): URLs that a page says are one, by its canonical links and refreshes."""
    url, html = F.col("url"), F.coalesce(F.col("html"), F.lit(""))
    # html is searched only where a plain string search finds the words that such tags hold
    may = F.lower(html)
    named = may.contains("canonical") | may.contains("refresh")
    own = F.regexp_extract(html, BASE, 1)
    base = F.when(own != "", F.coalesce(resolved(unescaped(own), url), url)).otherwise(url)

    def targets(tag: str, attribute: str) -> Column:
        found = F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda x: unescaped(F.regexp_extract(x, attribute, 1)))
        return F.filter(found, lambda x: x != "")

    ends = F.concat(targets(CANONICAL, HREF), targets(REFRESH, TARGET))
    found = pages.where(url.contains("://") & named).select(url.alias("a"), base.alias("base"), F.explode(ends).alias("link"))
    return found.select("a", resolved(F.col("link"), F.col("base")).alias("b")).where("b is not null")


def judged(pages: DataFrame, rules: list[tuple[str, str]], scratch: Scratch, redirects: DataFrame | None = None, spellings: bool = True) -> DataFrame:
    """(page_id, url, host, path, rule, verdict) of every page; ``redirects`` may add edges (a, b)."""
    edges = links(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("a", "b").where("a is not null and b is not null"))
    edges = scratch.keep(edges.where("a != b").distinct())
    if spellings:
        nodes = pages.select("url").union(edges.select("a")).union(edges.select("b")).where(F.col("url").contains("://")).distinct()
        edges = edges.unionByName(nodes.select(F.col("url").alias("a"), spelling(F.col("url")).alias("b")))
    edges = scratch.keep(edges.where("a != b").distinct())
    name = lambda c: F.unhex(F.md5(c))
    roots = components(edges.select(name(F.col("a")).alias("a"), name(F.col("b")).alias("b")), scratch)
    urls = edges.select(F.col("a").alias("url")).union(edges.select(F.col("b").alias("url"))).distinct()
    bad = urls.where(rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"] == "block").select(name(F.col("url")).alias("node"))
    tainted = roots.join(bad, "node").select("root").distinct()
    aliases = scratch.keep(roots.join(tainted, "root").select(F.col("node").alias("__node"), F.lit(True).alias("__blocked")))
    placed = pages.select("page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    placed = placed.withColumns({"__rule": rule_of(F.col("host"), F.col("path"), rules), "__node": name(F.col("url"))})
    by_alias = F.when(F.col("__blocked"), "block").otherwise("allow")
    return placed.join(aliases, "__node", "left").select(
        "page_id", "url", "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce(F.col("__rule.verdict"), by_alias).alias("verdict")
    )


#: The rules of the query.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES, Scratch(spark, "op7")).drop("url")


def _sql() -> str:
    """The query as SQL; it knows absolute links and those that begin with a slash, and of entities &amp; alone."""
    q = lambda s: s.replace("'", "''")
    host = lambda u: f"translate(coalesce(regexp_extract({u}, '{PLACE}', 1), ''), '{UPPER}', '{LOWER}')"
    path = lambda u: f"coalesce(regexp_extract({u}, '{PLACE}', 2), '')"
    scheme = "regexp_extract(url, '(?s)^(.*?)://', 1)"
    rules = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)
    query = f"regexp_replace(regexp_replace(regexp_extract(url, '(?s)^[^?#]*\\?([^#]*)', 1), '{TRACKING}', '', 'g'), '^&', '')"
    spelled = f"""'https://' || regexp_replace({host("url")}, '^(?:www|m)\\.', '') || regexp_replace(regexp_replace({path("url")}, '(?:/index)?\\.html?$', ''), '/+$', '') || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END"""
    found = lambda tag, attribute: f"list_transform(regexp_extract_all(coalesce(html, ''), '{q(tag)}'), lambda x: replace(regexp_extract(x, '{q(attribute)}', 1), '&amp;', '&'))"
    resolved_ = f"CASE WHEN link LIKE '%://%' THEN link WHEN link LIKE '//%' THEN {scheme} || ':' || link WHEN link LIKE '/%' THEN {scheme} || '://' || {host('url')} || link END"
    return f"""
WITH RECURSIVE rules(verdict, rule, host, path) AS (VALUES {rules}),
l AS (SELECT url, unnest(list_concat({found(CANONICAL, HREF)}, {found(REFRESH, TARGET)})) AS link FROM pages WHERE url LIKE '%://%'),
k AS (SELECT url AS a, {resolved_} AS b FROM l WHERE link <> ''),
nodes AS (SELECT url FROM pages WHERE url LIKE '%://%' UNION SELECT a FROM k UNION SELECT b FROM k WHERE b IS NOT NULL),
e AS (SELECT a, b FROM k UNION SELECT url, {spelled} FROM nodes),
s AS (SELECT a, b FROM e WHERE b IS NOT NULL UNION SELECT b, a FROM e WHERE b IS NOT NULL),
u AS (SELECT url, {host("url")} AS host, {path("url")} AS path FROM (SELECT a AS url FROM s)),
ru AS (SELECT u.url, r.verdict, row_number() OVER (PARTITION BY u.url ORDER BY length(r.rule) DESC) AS n FROM (SELECT DISTINCT * FROM u) u JOIN rules r ON (u.host = r.host OR suffix(u.host, '.' || r.host)) AND starts_with(u.path, r.path)),
reach AS (SELECT url FROM ru WHERE n = 1 AND verdict = 'block' UNION SELECT s.b FROM reach JOIN s ON s.a = reach.url),
p AS (SELECT page_id, url, {host("url")} AS host, {path("url")} AS path FROM pages),
d AS (SELECT p.page_id, r.rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC) AS n FROM p JOIN rules r ON (p.host = r.host OR suffix(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, d.rule, coalesce(d.verdict, CASE WHEN p.url IN (SELECT url FROM reach) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN d ON p.page_id = d.page_id AND d.n = 1
"""


OP7_SQL = _sql()
