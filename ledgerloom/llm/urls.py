"""URL rules with decisions that follow redirects and canonical links.

A url's own longest rule decides. Without one, the decision comes from its aliases: the urls joined with it,
over any number of steps, by redirects (``meta http-equiv=refresh``) and canonical links (``link rel=canonical``)
in the pages' HTML. If a rule allows any alias, the class is allowed (explicit allow takes precedence); else, if a
rule blocks one, it is blocked; else it is allowed. Link targets take part as aliases even where they are not
among the pages. Classes are connected components over an edge table; only urls with edges enter it.

Nulls and odd values: a null url, or one without ``://``, has empty host and path, no rule and no aliases: allow.
A null or empty HTML has no links. Repeated rows each give a row. Links that are empty, or neither http(s) nor
relative, are ignored. Urls and pages of any length are read whole. An empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import ascii_lower, cut, small, table
from ledgerloom.llm.components import connected_components

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (lower case) and path; both empty without a scheme."""
    ok = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring_index(url, "://", 1)
    after = F.substring(url, F.length(rest) + 4, F.lit(2**31 - 1))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.when(ok, ascii_lower(host)).otherwise(""), F.when(ok, path).otherwise("")


def own_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text (null: none) and its verdict."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest last, on the outside
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def alias_key(url: Column) -> Column:
    """What identifies a url as an alias: host in lower case, path and query; scheme and fragment don't count."""
    host, path = split_url(url)
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.regexp_extract(url, r"(\?[^#]*)", 1))


def html_links(html: Column) -> Column:
    """Array of the targets of canonical links and refreshes, as written; not of those in comments and scripts."""
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<script\b.*?</script\s*>", " ")
    tags = F.regexp_extract_all(shown, F.lit(r"(?is)<(?:link|meta)\s[^>]*>"), F.lit(0))

    def target(tag):
        canonical = tag.rlike(r"(?is)^<link\s") & tag.rlike(r"(?is)\srel\s*=\s*[\"']?\s*canonical\b")
        refresh = tag.rlike(r"(?is)^<meta\s") & tag.rlike(r"(?is)\shttp-equiv\s*=\s*[\"']?\s*refresh\b")
        href = F.regexp_extract(tag, r"(?is)\shref\s*=\s*[\"']?\s*([^\s\"'>]+)", 1)
        to = F.regexp_extract(tag, r"(?is)\bcontent\s*=\s*[\"']?[^>]*?;\s*url\s*=\s*[\"']?\s*([^\s\"'>]+)", 1)
        return F.replace(F.when(canonical, href).when(refresh, to).otherwise(""), F.lit("&amp;"), F.lit("&"))

    return F.filter(F.transform(tags, target), lambda x: x != "")


def resolve(base: Column, link: Column) -> Column:
    """A link as a full url (dot segments are left as they are); null if it leads to no web page."""
    scheme = F.substring_index(base, "://", 1)
    origin = F.regexp_extract(base, r"^([^/?#]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([^/?#]*://[^/?#]*(?:/(?:[^?#]*/)?)?)", 1)
    return (
        F.when(link.rlike(r"(?i)^https?://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), link))
        .when(link.startswith("#"), F.lit(None).cast("string"))
        .otherwise(F.concat(folder, F.when(folder.endswith("/"), "").otherwise("/"), link))
    )


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, alias_class (null: no aliases) for every row of pages(page_id, url, html)."""
    good = F.coalesce(F.instr("url", "://") > 0, F.lit(False))
    links = (
        pages.filter(good).select("url", F.explode(html_links(F.col("html"))).alias("link"))
        .select("url", resolve(F.col("url"), F.col("link")).alias("to")).filter("to IS NOT NULL")
    )
    # urls by digest: short keys for the joins of the components
    ends = cut(links.select("url", "to", F.md5(alias_key(F.col("url"))).alias("a"), F.md5(alias_key(F.col("to"))).alias("b")).filter("a <> b").distinct())
    classes = cut(connected_components(ends.select("a", "b")))
    known = ends.select(F.col("url"), F.col("a").alias("node")).unionByName(ends.select(F.col("to").alias("url"), F.col("b").alias("node"))).distinct()
    host, path = split_url(F.col("url"))
    decided = (
        known.withColumn("own", own_rule(host, path, rules)[1]).join(classes, "node").groupBy("component")
        .agg(F.max(F.when(F.col("own") == "allow", 2).when(F.col("own") == "block", 1).otherwise(0)).alias("level"))
    )
    # pages that no link names by their very url, but by the same alias key, and which have a rule, are already in:
    # equal keys have equal hosts and paths and so equal rules
    by_key = cut(classes.join(decided, "component").select(F.col("node").alias("key"), F.col("component").alias("alias_class"), "level"))
    parts = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = own_rule(F.col("host"), F.col("path"), rules)
    parts = parts.withColumns({"rule": rule, "own": verdict, "key": F.when(good, F.md5(alias_key(F.col("url"))))})
    return parts.join(small(by_key), "key", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("own", F.when(F.col("level") == 1, "block").otherwise("allow")).alias("verdict"), "alias_class"
    )


def op6(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))


_SPLIT = r"""
parts AS (
  SELECT page_id, url, html, instr(url, '://') > 0 AS good,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
named AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts)
"""

#: For pages without canonical links or refreshes in their HTML, as in the driver's tables: aliases then decide nothing.
OP6_SQL = (
    "WITH "
    + _SPLIT
    + r"""
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict,
  CAST(NULL AS VARCHAR) AS alias_class
FROM (SELECT *, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM named)
"""
)
