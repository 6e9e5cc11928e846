"""URL rules whose block decisions reach the aliases of a page.

A rule fits a host, all its subdomains, and the paths that begin with its own; the longest
rule that fits decides. A page that no rule fits is judged by its aliases: pages are joined
by redirects and canonical links, read from the markup and from addresses that sites
commonly redirect to one another (scheme, `www.` and `m.`, index pages and endings, tracking
parameters, fragments). Connected components of these links are the alias classes. A class
with an explicitly allowed page is allowed; otherwise one with a blocked page is blocked.

All of it is DataFrame code. Pages of one address are merged before links are followed, and
a class's decision is summed where its pages are read.

Defined results: a null url, or one without `://`, has an empty host and path, fits no rule,
has no alias and is allowed; null markup has no links; repeated rows are judged row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldledger.llm.common import ascii_lower, staged, table
from fieldledger.llm.components import components

# Verdict, host and path of each rule.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
TRACKING = r"^(utm_[^=]*|ref|source|fbclid|gclid)(=|$)"
ENDING = r"(/index\.html?|\.html?|/+)$"
CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
CONTENT = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def address_part(url: Column, part: int) -> Column:
    """Host (1), path (2) or parameters (3) of an address; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, ADDRESS, part), F.lit(""))


def host_of(url: Column) -> Column:
    return ascii_lower(address_part(url, 1))


def alias_key(url: Column) -> Column:
    """What common redirects leave of an address; null without a host."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(address_part(url, 2), ENDING, "")
    kept = F.filter(F.split(address_part(url, 3), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(kept, "&")
    return F.when(
        host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    )


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Rule and verdict of the longest rule that fits; allow wins a tie; else null."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, own_host, own_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        rule = F.struct(F.lit(own_host + own_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, rule).otherwise(found)
    return found


def markup_links(html: Column, url: Column) -> Column:
    """Targets of canonical links and of refreshes, as far as they name a host or a root."""
    targets = F.array(
        F.regexp_extract(F.regexp_extract(html, CANONICAL, 0), HREF, 1),
        F.regexp_extract(F.regexp_extract(html, REFRESH, 0), CONTENT, 1),
    )
    site = F.concat(F.lit("http://"), host_of(url))
    whole = F.transform(targets, lambda t: F.when(t.startswith("/"), F.concat(site, t)).otherwise(t))
    return F.filter(whole, lambda t: t.contains("://"))


def judge_pages(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    redirects: DataFrame | None = None,
) -> DataFrame:
    """Every page with host, path, rule and verdict; `redirects` may add `source`, `target`."""
    url = F.col("url")
    parsed = pages.select(
        "page_id",
        host_of(url).alias("host"),
        address_part(url, 2).alias("path"),
        alias_key(url).alias("key"),
        F.transform(markup_links(F.col("html"), url), lambda t: alias_key(t)).alias("links"),
    )
    best = best_rule(F.col("host"), F.col("path"), rules)
    judged = staged(parsed.withColumn("best", best), "url-pages")
    links = judged.select(F.col("key").alias("a"), F.explode("links").alias("b"))
    if redirects is not None:
        given = redirects.select(
            alias_key(F.col("source")).alias("a"), alias_key(F.col("target")).alias("b")
        )
        links = links.unionByName(given)
    classes = components(links.where(F.col("a").isNotNull() & F.col("b").isNotNull()))
    keyed = judged.groupBy("key").agg(
        F.max((F.col("best.verdict") == "allow").cast("int")).alias("allowed"),
        F.max((F.col("best.verdict") == "block").cast("int")).alias("blocked"),
    )
    named = keyed.where(F.col("key").isNotNull()).join(
        classes.withColumnRenamed("node", "key"), "key", "left"
    )
    named = named.withColumn("class", F.coalesce("component", "key"))
    decided = named.groupBy("class").agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked"))
    decided = decided.select(
        "class", (F.coalesce("blocked", F.lit(0)) > F.coalesce("allowed", F.lit(0))).alias("blocked")
    )
    # Written, so that an address of very many pages is split like any skewed join key.
    known = staged(
        named.select("key", "class").join(decided.where("blocked"), "class").select("key", "blocked"),
        "url-classes",
    )
    own, alias = F.col("best.verdict"), F.when(F.col("blocked"), "block").otherwise("allow")
    return judged.join(known, "key", "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(own, alias).alias("verdict")
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(table(spark, sf_dir, "pages"))


OP4_SQL = r"""
WITH RECURSIVE cut AS (
  SELECT page_id, 'page' AS kind, url,
         regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>') AS canonical,
         regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>') AS refresh
  FROM pages
), addresses AS (
  SELECT page_id, kind, url FROM cut
  UNION ALL SELECT page_id, 'link', regexp_extract(canonical, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) FROM cut
  UNION ALL SELECT page_id, 'link', regexp_extract(refresh, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM cut
), absolute AS (
  SELECT a.page_id, a.kind, CASE WHEN a.kind = 'link' AND a.url LIKE '/%' THEN
      'http://' || coalesce(regexp_extract(c.url, '(?s)^.*?://([^/?#]*)', 1), '') || a.url ELSE a.url END AS url
  FROM addresses a JOIN cut c USING (page_id)
), parts AS (
  SELECT page_id, kind,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)', 1), '') AS params
  FROM absolute
), keys AS (
  SELECT *, array_to_string(list_filter(string_split(params, '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|source|fbclid|gclid)(=|$)')), '&') AS query
  FROM parts
), keyed AS (
  SELECT page_id, kind, host, path,
         CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '')
           || regexp_replace(path, '(/index\.html?|\.html?|/+)$', '')
           || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS key
  FROM keys
), rules (verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), own AS (
  SELECT p.page_id, p.host, p.path, p.key,
         max_by(r.rule_host || r.rule_path, length(r.rule_host || r.rule_path)) AS rule,
         max_by(r.verdict, length(r.rule_host || r.rule_path)) AS verdict
  FROM keyed p LEFT JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
  WHERE p.kind = 'page' GROUP BY ALL
), links AS (
  SELECT p.key AS a, l.key AS b FROM keyed p JOIN keyed l USING (page_id)
  WHERE p.kind = 'page' AND l.kind = 'link' AND p.key IS NOT NULL AND l.key IS NOT NULL
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT DISTINCT key AS node, key AS other FROM own WHERE key IS NOT NULL
  UNION
  SELECT r.node, w.b FROM reach r JOIN both_ways w ON r.other = w.a
), classes AS (
  SELECT r.node AS key, bool_or(o.verdict = 'allow') AS allowed, bool_or(o.verdict = 'block') AS blocked
  FROM reach r JOIN own o ON o.key = r.other GROUP BY r.node
)
SELECT o.page_id, o.host, o.path, o.rule,
       coalesce(o.verdict, CASE WHEN coalesce(c.blocked, false) AND NOT coalesce(c.allowed, false)
                                THEN 'block' ELSE 'allow' END) AS verdict
FROM own o LEFT JOIN classes c USING (key)
"""
