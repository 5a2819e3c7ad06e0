"""Differences of two crawls of every site, with sites that moved, crawls that stopped early, robots files and sitemaps.

A site is a host of pages; its snapshots are made from the crawled pages. By the length of its name it moves from http to https
or to www, stops early, or is blocked; a tenth of its pages keep the address that they have, on the site's origin or off it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import crawl_diff as D
from pagewright.plans.fixtures import BASE, crawl_pages
from pagewright.plans.registry import query
from pagewright.session import cut_lineage

_HOME = "concat(CASE WHEN crawl_id = 1 AND length(host) % 3 = 0 THEN 'http://' WHEN crawl_id = 2 AND length(host) % 3 = 1 THEN 'https://www.' ELSE 'https://' END, host)"
_REST = "regexp_extract(url, '^https?://[^/?#]*(.*)$', 1)"
_AT = f"CASE WHEN page_id % 10 = 9 THEN url ELSE concat({_HOME}, CASE WHEN {_REST} LIKE '/%' THEN {_REST} ELSE concat('/', {_REST}) END) END"
#: Rules of a page's snapshot and of a site's, alike in both engines.
_PAGE = {"url": _AT, "canonical": f"CASE WHEN canonical = url THEN {_AT} ELSE canonical END"}
_SITE = {
    "stop": "CASE (length(host) + crawl_id) % 5 WHEN 0 THEN 'page_limit' WHEN 1 THEN CASE WHEN crawl_id = 2 THEN 'robots_blocked' ELSE 'completed' END ELSE 'completed' END",
    "robots_status": "CASE WHEN (length(host) + crawl_id) % 7 = 0 THEN NULL WHEN length(host) % 11 = 0 THEN 404 ELSE 200 END",
    "sitemap_whole": "length(host) % 4 <> 2",
}


def snapshots(spark, sf_dir):
    """Pages and crawls of both crawls (crawl_id 1 and 2), and the starred pages."""
    same = ["crawl_id", F.col("host").alias("site_id"), "page_id", "status", "error", "indexability", "title", "hops", "inlinks", "in_sitemap"]
    rows = crawl_pages(spark, sf_dir).select(*same, *(F.expr(e).alias(c) for c, e in _PAGE.items()), F.expr(_HOME).alias("home"), F.col("host"))
    rows = cut_lineage(rows)
    listed = F.count_if(F.col("in_sitemap") & ((F.col("crawl_id") == 1) | (F.col("page_id") % 8 != 1))).alias("sitemap_urls")
    rules = F.coalesce(F.sum(F.when(F.col("page_id") % 6 == 0, F.col("page_id"))), F.lit(0)).cast("string").alias("robots_print")
    sites = rows.groupBy("crawl_id", "site_id", "host", "home").agg(listed, rules)
    sites = sites.select("crawl_id", "site_id", F.concat("home", F.lit("/")).alias("origin"), "sitemap_urls", "robots_print", *(F.expr(e).alias(c) for c, e in _SITE.items()))
    return rows, cut_lineage(sites), rows.where("crawl_id = 2 AND page_id % 30 = 3").select("site_id", "url")


_FAILS = "({0}.status >= 400 OR {0}.status = 0 AND {0}.error IS NOT NULL)"
_STATE = "CASE {0}.indexability " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in D.STATE_NAMES.items()) + " END"
_MATCH = "p.url IS NOT NULL AND q.url IS NOT NULL"
_ANEW = f"{_FAILS.format('p')} AND NOT {_FAILS.format('q')}"
_KINDS = {
    "new_url": ("q.url IS NULL AND q_whole", "2", "''", "CAST(p.status AS VARCHAR)"),
    "removed_url": ("p.url IS NULL AND p_whole", "2", "CAST(q.status AS VARCHAR)", "''"),
    "status_changed": (f"{_MATCH} AND p.status <> q.status", f"CASE WHEN {_ANEW} THEN 1 ELSE 2 END", "CAST(q.status AS VARCHAR)", "CAST(p.status AS VARCHAR)"),
    "became_noindex": (f"{_MATCH} AND p.indexability = 'noindex' AND q.indexability <> 'noindex'", "1", _STATE.format("q"), _STATE.format("p")),
    "title_changed": (f"{_MATCH} AND trim(p.title) <> '' AND trim(q.title) <> '' AND trim(p.title) <> trim(q.title)", "2", "trim(q.title)", "trim(p.title)"),
    "title_removed": (f"{_MATCH} AND trim(p.title) = '' AND trim(q.title) <> ''", "1", "trim(q.title)", "''"),
    "canonical_changed": (f"{_MATCH} AND p.canonical IS DISTINCT FROM q.canonical", "2", "coalesce(q.canonical, 'none')", "coalesce(p.canonical, 'none')"),
    "redirect_chain_grew": (f"{_MATCH} AND p.hops > q.hops", "2", "CAST(q.hops AS VARCHAR)", "CAST(p.hops AS VARCHAR)"),
}
#: Of rows of one address the least counts.
_LEAST = "QUALIFY row_number() OVER (PARTITION BY site_id, url ORDER BY status, error NULLS FIRST, indexability, trim(title), canonical NULLS FIRST, hops, inlinks) = 1"
_SQL = BASE + f""", snap AS (SELECT crawl_id, host AS site_id, page_id, status, error, indexability, title, hops, inlinks, in_sitemap, {_HOME} AS home, {_PAGE['canonical']} AS canonical, {_AT} AS url FROM cp),
crawl AS (SELECT crawl_id, host AS site_id, {_HOME} || '/' AS origin, count(*) FILTER (in_sitemap AND (crawl_id = 1 OR page_id % 8 <> 1)) AS sitemap_urls, CAST(coalesce(sum(page_id) FILTER (page_id % 6 = 0), 0) AS VARCHAR) AS robots_print, {", ".join(f"{e} AS {c}" for c, e in _SITE.items())} FROM cp GROUP BY crawl_id, host),
both_sites AS (SELECT p.site_id, p.origin AS p_origin, q.origin AS q_origin, p.stop AS p_stop, q.stop AS q_stop, p.stop = 'completed' AS p_whole, q.stop = 'completed' AS q_whole, p.robots_status AS p_robots, q.robots_status AS q_robots, p.robots_print AS p_print, q.robots_print AS q_print,
 p.sitemap_urls AS p_urls, q.sitemap_urls AS q_urls, p.sitemap_whole AND q.sitemap_whole AS sm_whole FROM crawl p JOIN crawl q ON q.site_id = p.site_id AND p.crawl_id = 2 AND q.crawl_id = 1),
now AS (SELECT * FROM (SELECT s.* FROM snap s JOIN both_sites b USING (site_id) WHERE crawl_id = 2 AND starts_with(s.url, b.p_origin)) {_LEAST}),
then_ AS (SELECT * FROM (SELECT s.* REPLACE (b.p_origin || substr(s.url, length(b.q_origin) + 1) AS url, CASE WHEN starts_with(s.canonical, b.q_origin) THEN b.p_origin || substr(s.canonical, length(b.q_origin) + 1) ELSE s.canonical END AS canonical) FROM snap s JOIN both_sites b USING (site_id) WHERE crawl_id = 1 AND starts_with(s.url, b.q_origin)) {_LEAST}),
keys AS (SELECT site_id, url FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY inlinks DESC, url) AS r FROM now) WHERE r <= 20 UNION SELECT site_id, p_origin FROM both_sites UNION SELECT site_id, url FROM snap WHERE crawl_id = 2 AND page_id % 30 = 3),
j AS (SELECT p, q, coalesce(p.site_id, q.site_id) AS site_id, coalesce(p.url, q.url) AS url FROM now p FULL JOIN then_ q ON p.site_id = q.site_id AND p.url = q.url),
k AS (SELECT j.*, b.* EXCLUDE (site_id), (j.site_id, j.url) IN (SELECT (site_id, url) FROM keys) AS is_key FROM j JOIN both_sites b USING (site_id)),
page_changes AS ({" UNION ALL ".join(f"SELECT site_id, '{n}' AS kind, greatest(0, {r} - CAST(is_key AS INTEGER)) AS rank, url, {b} AS before, {a} AS after FROM k WHERE {w}" for n, (w, r, b, a) in _KINDS.items())}),
counts AS (SELECT site_id, count(p.url) AS pages, count(*) FILTER (p.url IS NOT NULL AND {_FAILS.format('p')} AND CASE WHEN q.url IS NULL THEN q_whole ELSE NOT {_FAILS.format('q')} END) AS anew, count(*) FILTER (q.url IS NOT NULL AND {_FAILS.format('q')}) AS were, count(*) FILTER (p.url IS NOT NULL AND {_FAILS.format('p')}) AS are_ FROM k GROUP BY 1),
rb AS (SELECT *, p_stop = 'robots_blocked' AND q_stop <> 'robots_blocked' AS blocked, coalesce(p_robots = q_robots AND p_print <> q_print, false) AS rules FROM both_sites)
SELECT site_id, kind, CASE rank WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'notice' END AS severity, url, before, after FROM page_changes
UNION ALL SELECT site_id, 'site_moved', 'critical', NULL, q_origin, p_origin FROM both_sites WHERE p_origin <> q_origin
UNION ALL SELECT site_id, 'error_spike', 'critical', NULL, CAST(were AS VARCHAR), CAST(are_ AS VARCHAR) FROM counts WHERE anew >= greatest(3, ceil(pages * 2 / 100))
UNION ALL SELECT site_id, 'robots_txt_changed', CASE WHEN blocked THEN 'critical' ELSE 'warning' END, NULL, coalesce(CAST(q_robots AS VARCHAR), 'none'), coalesce(CAST(p_robots AS VARCHAR), 'none') || CASE WHEN rules AND blocked THEN ' (rules changed, blocks the crawl)' WHEN rules THEN ' (rules changed)' WHEN blocked THEN ' (blocks the crawl)' ELSE '' END
 FROM rb WHERE p_robots IS DISTINCT FROM q_robots OR rules OR blocked
UNION ALL SELECT site_id, 'sitemap_shrank', 'warning', NULL, CAST(q_urls AS VARCHAR), CAST(p_urls AS VARCHAR) FROM both_sites WHERE sm_whole AND q_urls > 0 AND p_urls * 10 <= q_urls * 9"""


@query("d1_sites", _SQL)
def d1_sites(spark, sf_dir):
    """All twelve kinds of change between two crawls of every site."""
    pages, sites, starred = snapshots(spark, sf_dir)
    before, after = ((sites.where(f"crawl_id = {k}"), pages.where(f"crawl_id = {k}")) for k in (1, 2))
    return D.crawl_changes(before, after, starred)


@query("j5_moves", BASE + f""", snap AS (SELECT crawl_id, host AS site_id, regexp_extract({_AT}, '^([a-z]+://[^/?#]*)', 1) || '/' AS origin FROM cp),
home AS (SELECT crawl_id, site_id, origin FROM (SELECT *, row_number() OVER (PARTITION BY crawl_id, site_id ORDER BY n DESC, regexp_replace(origin, '/$', '') || CASE WHEN origin LIKE 'https:%' THEN ':443' ELSE ':80' END) AS r FROM (SELECT crawl_id, site_id, origin, count(*) AS n FROM snap GROUP BY ALL)) WHERE r = 1)
SELECT p.site_id, q.origin AS before, p.origin AS after FROM home p JOIN home q ON q.site_id = p.site_id AND q.crawl_id = 1 WHERE p.crawl_id = 2 AND p.origin <> q.origin""")
def j5_moves(spark, sf_dir):
    """Sites whose origin, the one of most of their pages, is another one in the later crawl."""
    pages, _, _ = snapshots(spark, sf_dir)
    before, after = (D.home_origins(pages.where(f"crawl_id = {k}")).withColumnRenamed("origin", c) for k, c in ((1, "before"), (2, "after")))
    return before.join(after, "site_id").where("before <> after")
