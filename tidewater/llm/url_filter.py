"""URL filter with redirect equivalence (native).

A rule names a host suffix and a path prefix.  A url without a rule of its own
takes the decision of its aliases: urls are joined by canonical links and redirects
(those of a page's own html and, as a table, those that a crawl logged), distributed connected
components find the alias classes, and one blocked member blocks the members that no
rule names.  An explicit allow always wins for the url that it names, and never spreads.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.components import connected_components
from tidewater.llm.shared import Scratch

#: (host, path prefix, verdict)
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]

_LINK = r"""(?is)<link\b[^>]*?\brel\s*=\s*["']?canonical\b["']?[^>]*>"""
_META = r"""(?is)<meta\b[^>]*?\bhttp-equiv\s*=\s*["']?refresh\b["']?[^>]*>"""
_HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
_GOTO = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""


def lower_ascii(col):
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url):
    """After the first ``://`` up to /, ?, # or the end; empty without ``://`` or url."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url):
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_verdict(host, path, rules=None):
    """Struct (rule, verdict) of the longest fitting rule, or nulls.

    Longest: by the text host + path; of equally long rules an allow comes first, then the
    first in text order.  ``rules`` is a short list of the filter's configuration, part of the plan.
    """
    rules = sorted(RULES if rules is None else rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "allow", r[0] + r[1]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in reversed(rules):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def canonical_url(url):
    """Where a site's trivial redirects lead: https, lower-case host, no fragment,
    tracking parameters or trailing slash."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    left = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)")), "&")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    return F.when(url.contains("://"), F.concat(F.lit("https://"), host_of(url), path, F.when(left != "", F.concat(F.lit("?"), left)).otherwise(F.lit(""))))


def absolute(href, url):
    """``href`` seen from ``url``: absolute, scheme-relative, root-relative or relative to the last slash."""
    root = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    base = F.concat(root, F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1))
    return (F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
             .when(href.startswith("//"), F.concat(F.lit("https:"), href))
             .when(href.startswith("/"), F.concat(root, href))
             .otherwise(F.concat(F.when(base == root, F.concat(root, F.lit("/"))).otherwise(base), href)))


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html", same_form: bool = False) -> DataFrame:
    """(source, target) urls of canonical links and client redirects; with ``same_form`` also
    an edge from every url to its ``canonical_url``, for sites known to redirect so."""
    url, html = F.col("url"), F.col("html")
    p = pages.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).where(url.contains("://"))
    link = F.nullif(F.regexp_extract(F.regexp_extract(html, _LINK, 0), _HREF, 1), F.lit(""))
    goto = F.nullif(F.regexp_extract(F.regexp_extract(html, _META, 0), _GOTO, 1), F.lit(""))
    lower = F.lower(html)
    found = [F.when(F.contains(lower, F.lit("canonical")), absolute(link, url)), F.when(F.contains(lower, F.lit("refresh")), absolute(goto, url))]
    if same_form:
        found.append(canonical_url(url))
    return p.select(url.alias("source"), F.explode(F.array(*found)).alias("target")).where("target is not null")


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html",
               rules=None, edges: DataFrame | None = None, same_form: bool = False) -> DataFrame:
    """One row per page: (id, url, host, path, rule, verdict, decided_by, component).

    A null url, or one without ``://``, has empty host and path, joins no alias class and is
    allowed unless a rule fits.  A redirect target that is no page also counts as a
    member: a rule that blocks it blocks its aliases.  Urls are nodes by text: repeated urls,
    also under several ids, are one node.  ``decided_by`` is rule, alias or default.
    ``edges`` (source, target) adds a crawl's redirect log, ``same_form`` the trivial redirects of
    ``link_edges``.  Pages without any link keep their own decision.  An empty table gives no row.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "url-filter")
    links = link_edges(pages, url_col, html_col, same_form) if html_col else None
    if edges is not None:
        more = edges.select(F.col("source"), F.col("target"))
        links = more if links is None else links.union(more)
    # a node is a url's 64-bit hash; the two urls of one hash would have to share their fate
    links = scratch.write(links.select(F.xxhash64("source").alias("a"), F.xxhash64("target").alias("b"), "source", "target")
                          .where("a is not null and b is not null").distinct(), "links")
    groups = connected_components(links, scratch)
    urls = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("source").alias("url")),
                                          F.struct(F.col("b").alias("node"), F.col("target").alias("url")))).alias("s")).select("s.*")
    _, verdict = rule_verdict(host_of(F.col("url")), path_of(F.col("url")), rules)
    blocked = urls.where(verdict == "block").select("node").distinct()
    blocked_groups = groups.join(blocked, "node").select("component").distinct().withColumn("hit", F.lit(True))
    fate = groups.join(blocked_groups, "component", "left").select("node", "component", F.coalesce("hit", F.lit(False)).alias("hit"))
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    p = p.withColumns({"host": host, "path": path, "node": F.when(F.col("url").contains("://"), F.xxhash64("url"))})
    name, verdict = rule_verdict(F.col("host"), F.col("path"), rules)
    p = p.withColumns({"rule": name, "ruled": verdict})
    out = p.join(fate, "node", "left")
    hit = F.coalesce(F.col("hit"), F.lit(False))
    return out.select("id", "url", "host", "path", "rule",
                      F.coalesce("ruled", F.when(hit, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
                      F.when(F.col("ruled").isNotNull(), "rule").when(hit, "alias").otherwise("default").alias("decided_by"),
                      F.col("component"))


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = judge_urls(pages)
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "decided_by")


OP6_SQL = r"""
WITH p AS (SELECT page_id, url, html,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
u AS (SELECT DISTINCT url, html FROM p WHERE url LIKE '%://%'),
named AS (SELECT url, regexp_extract(regexp_extract(html, '<link\b[^>]*?\brel\s*=\s*["'']?canonical\b["'']?[^>]*>', 0, 'is'), '\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'is') AS href FROM u
  UNION ALL SELECT url, regexp_extract(regexp_extract(html, '<meta\b[^>]*?\bhttp-equiv\s*=\s*["'']?refresh\b["'']?[^>]*>', 0, 'is'), '\burl\s*=\s*["'']?([^"''\s>]+)', 1, 'is') FROM u),
parts AS (SELECT url, href, regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') AS root,
    regexp_extract(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '^(.*/)', 1, 's') AS folder FROM named WHERE href <> ''),
edge AS (SELECT url AS a, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href WHEN starts_with(href, '//') THEN 'https:' || href
     WHEN starts_with(href, '/') THEN root || href WHEN folder = '' THEN root || '/' || href ELSE root || folder || href END AS b FROM parts),
node AS (SELECT a AS url FROM edge UNION SELECT b FROM edge),
judged AS (SELECT url, (SELECT v FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
      ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS r(h, s, v)
    WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) ORDER BY length(h || s) DESC LIMIT 1) AS v
  FROM (SELECT url, translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM node)),
near AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
bad AS (WITH RECURSIVE w(url) AS (SELECT url FROM judged WHERE v = 'block' UNION SELECT near.b FROM w JOIN near ON near.a = w.url) SELECT url FROM w),
ruled AS (SELECT p.*, (SELECT h || s FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
      ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS r(h, s, v)
    WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) ORDER BY length(h || s) DESC LIMIT 1) AS rule FROM p)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN url IN (SELECT url FROM bad) THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NOT NULL THEN 'rule' WHEN url IN (SELECT url FROM bad) THEN 'alias' ELSE 'default' END AS decided_by
FROM ruled
"""
