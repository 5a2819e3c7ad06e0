"""Deterministic audit tables derived from the plain tables of a folder: crawled pages, links, crawls, changes.

Each derived column has one rule in SQL that Spark and DuckDB read alike; BASE holds the same tables as common table
expressions for the SQL side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.session import cut_lineage

#: Rules over page_id, crawl_id, k, url, next_url, n (pages) and html columns cut before.
FIRST_RULES = {
    "status": "CASE WHEN page_id = 0 THEN 200 WHEN k % 29 = 0 THEN 404 WHEN k % 31 = 0 THEN 500 WHEN k % 17 = 0 THEN 301 WHEN k % 37 = 0 THEN 0 ELSE 200 END",
    "title": "CASE WHEN k % 41 = 0 THEN '' WHEN k % 43 = 0 THEN 'Untitled' WHEN k % 44 = 1 THEN concat(raw_title, ' ', raw_title) ELSE raw_title END",
    "canonical": "CASE WHEN k % 7 = 0 THEN NULL WHEN k % 13 = 0 THEN next_url ELSE url END",
    "meta_robots": "CASE WHEN k % 11 = 0 THEN 'noindex' WHEN k % 47 = 0 THEN 'nosnippet, max-snippet:0' ELSE NULL END",
    "response_ms": "page_id * 37 % 1700",
    "in_sitemap": "page_id % 3 <> 0",
    "description": "CASE WHEN k % 5 = 0 THEN NULL WHEN k % 9 = 0 THEN substr(raw_description, 1, 50) WHEN k % 9 = 1 THEN substr(raw_description, 1, 120) ELSE raw_description END",
    "depth": "CASE WHEN page_id = 0 THEN 0 WHEN page_id % 9 = 4 THEN NULL ELSE 1 + page_id % 5 END",
    "inlinks": "CASE WHEN page_id % 18 = 4 THEN 0 ELSE 1 + page_id * 13 % 40 END",
    "title_count": "CASE WHEN k % 53 = 0 THEN 2 ELSE 1 END",
    "h1_count": "CASE WHEN k % 59 = 0 THEN 0 WHEN k % 61 = 0 THEN 2 ELSE 1 END",
    "images_missing_alt": "CASE WHEN k % 4 = 0 THEN page_id % 5 ELSE 0 END",
    "mixed_content": "CASE WHEN k % 16 = 3 THEN 2 ELSE 0 END",
    "og_title": "CASE WHEN k % 6 = 0 THEN NULL ELSE raw_title END",
    "og_image": "CASE WHEN k % 15 = 0 THEN ' ' ELSE '/og.png' END",
    "jsonld": "CASE WHEN k % 10 = 0 THEN 'invalid' WHEN k % 10 < 3 THEN 'absent' ELSE 'valid' END",
    "hreflang_size": "CASE WHEN k % 8 = 0 THEN 2 ELSE 0 END",
    "hreflang_self": "k % 16 = 0",
    "content_type": "CASE WHEN k % 18 = 5 THEN 'application/pdf' WHEN k % 18 = 6 THEN NULL WHEN k % 18 = 7 THEN 'image/png' ELSE 'text/html; charset=utf-8' END",
    "outlinks_internal": "page_id * 7 % 12",
    "outlinks_nofollow": "CASE WHEN k % 14 = 0 THEN 1 ELSE 0 END",
    "nosnippet_words": "CASE WHEN k % 12 = 0 THEN 90 ELSE 0 END",
}
#: Rules over the columns above.
SECOND_RULES = {
    "error": "CASE WHEN status = 0 AND k % 4 = 0 THEN 'redirect_loop' WHEN status = 0 AND k % 2 = 0 THEN 'timeout' ELSE NULL END",
    "redirect_target": "CASE WHEN status = 301 THEN next_url ELSE NULL END",
    "hops": "CASE WHEN status = 301 THEN 1 + page_id % 3 ELSE 0 END",
    "has_noindex": "coalesce(meta_robots, '') = 'noindex'",
    "html_ok": "status BETWEEN 200 AND 299 AND (content_type IS NULL OR lower(content_type) LIKE '%text/html%' OR lower(content_type) LIKE '%application/xhtml+xml%')",
}
THIRD_RULES = {
    "indexability": "CASE WHEN status = 0 AND error IS NULL THEN 'blocked_by_robots' WHEN status < 200 OR status >= 500 THEN 'server_error' "
    "WHEN status BETWEEN 300 AND 399 THEN 'redirected' WHEN status BETWEEN 400 AND 499 THEN 'client_error' WHEN has_noindex THEN 'noindex' "
    "WHEN canonical IS NOT NULL AND canonical <> url THEN 'canonicalised' ELSE 'indexable' END",
}
#: Which pages a crawl saw: new and removed pages on either side, the root in both.
SEEN = "page_id = 0 OR (crawl_id = 2 AND page_id % 23 <> 0) OR (crawl_id = 1 AND page_id % 19 <> 0)"

_CUT = {
    "raw_title": ("trim(regexp_replace(regexp_extract(html,'<title>([^<]*)</title>',1),'\\\\s+',' '))", "trim(regexp_replace(regexp_extract(html,'<title>([^<]*)</title>',1),'\\s+',' ','g'))"),
    "h1": ("regexp_extract(html,'<h1>([^<]*)</h1>',1)", "regexp_extract(html,'<h1>([^<]*)</h1>',1)"),
    "article": ("regexp_replace(regexp_extract(html,'(?s)<article>(.*)</article>',1),'<[^>]*>',' ')", "regexp_replace(regexp_extract(html,'(?s)<article>(.*)</article>',1),'<[^>]*>',' ','g')"),
    "host": ("regexp_extract(url,'^https?://([^/?#]*)',1)", "regexp_extract(url,'^https?://([^/?#]*)',1)"),
    "path": ("regexp_extract(url,'^https?://[^/?#]*([^?#]*)',1)", "regexp_extract(url,'^https?://[^/?#]*([^?#]*)',1)"),
}


def _columns(rules: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in rules.items())


#: The same tables for the SQL side.
BASE = f"""
WITH RECURSIVE nn AS (SELECT count(*) AS n FROM pages),
p0 AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS url, html FROM pages),
p1 AS (SELECT page_id, url, {", ".join(f"{duck} AS {c}" for c, (_, duck) in _CUT.items())} FROM p0),
p2 AS (SELECT p1.*, substr(article, 1, 200) AS raw_description,
              CAST(len(regexp_extract_all(article, '[^ \\t\\n\\r]+')) AS BIGINT) AS word_count,
              x.url AS next_url, n
       FROM p1, nn, p0 x WHERE x.page_id = (p1.page_id + 1) % n),
p3 AS (SELECT * FROM (SELECT c.crawl_id, p2.*, page_id + 7 * (2 - c.crawl_id) AS k FROM p2, (VALUES (1), (2)) c(crawl_id)) WHERE {SEEN}),
p4 AS (SELECT *, {_columns(FIRST_RULES)} FROM p3),
p5 AS (SELECT *, {_columns(SECOND_RULES)} FROM p4),
cp AS (SELECT *, {_columns(THIRD_RULES)} FROM p5),
cur AS (SELECT * FROM cp WHERE crawl_id = 2),
prv AS (SELECT * FROM cp WHERE crawl_id = 1),
edges AS (SELECT CAST(l_orderkey % n AS BIGINT) AS from_id, CAST(l_partkey % n AS BIGINT) AS to_id, CAST((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS BIGINT) AS edge_seq,
                 l_linenumber = 7 AS nofollow, l_returnflag || l_linestatus AS anchor
          FROM lineitem, nn),
crawls AS (SELECT o_orderkey AS crawl_id, CAST(o_custkey % 20 AS BIGINT) AS site_id, CAST(o_orderdate AS TIMESTAMP) AS created_at,
                  CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 HOUR AS finished_at,
                  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'failed' ELSE 'running' END AS status,
                  CAST(CAST(floor(o_totalprice) AS BIGINT) % 101 AS BIGINT) AS health_score
           FROM orders),
changes AS (SELECT event_id AS change_id, CAST(user_id % 20 AS BIGINT) AS site_id, CAST(ts AS TIMESTAMP) AS created_at,
                   CASE event_type WHEN 'click' THEN 'status_changed' WHEN 'view' THEN 'new_url' WHEN 'error' THEN 'error_spike'
                                   WHEN 'signup' THEN 'title_changed' ELSE 'became_noindex' END AS kind,
                   CASE user_id % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'notice' END AS severity
            FROM events)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_pages(spark: SparkSession, sf_dir: str) -> int:
    """A count that Parquet's footers answer."""
    return table(spark, sf_dir, "pages").count()


def crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of crawls 1 and 2, with html cut to the columns that audits need."""
    n = n_pages(spark, sf_dir)
    raw = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "#.*$", "").alias("url"), "html")
    cut = raw.select("page_id", "url", *(F.expr(spark_sql).alias(c) for c, (spark_sql, _) in _CUT.items()))
    cut = cut.withColumns({"raw_description": F.substring("article", 1, 200), "word_count": F.regexp_count("article", F.lit("[^ \\t\\n\\r]+")).cast("long"), "n": F.lit(n).cast("long")})
    following = raw.select(((F.col("page_id") - 1 + n) % n).alias("page_id"), F.col("url").alias("next_url"))
    both = cut.join(following, "page_id").withColumn("crawl_id", F.explode(F.array(F.lit(1), F.lit(2))))
    both = both.withColumn("k", F.col("page_id") + 7 * (2 - F.col("crawl_id"))).where(SEEN)
    for rules in (FIRST_RULES, SECOND_RULES, THIRD_RULES):
        both = both.withColumns({c: F.expr(e) for c, e in rules.items()})
    return both


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl_pages(spark, sf_dir).where("crawl_id = 2")


#: The columns of a page that checks, scores and policies read; content_key stands for the article's text.
NARROW = (
    "page_id url host path status error hops redirect_target indexability has_noindex canonical meta_robots html_ok title title_count description h1 h1_count word_count "
    "images_missing_alt outlinks_internal outlinks_nofollow depth inlinks mixed_content response_ms og_title og_image jsonld hreflang_size hreflang_self in_sitemap content_key"
).split()


def narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current pages without their texts, written once to the shared checkpoint folder: html is parsed in one pass,
    whatever number of branches a plan then has over the pages."""
    return cut_lineage(current(spark, sf_dir).withColumn("content_key", F.sha2("article", 256)).select(*NARROW))


def previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl_pages(spark, sf_dir).where("crawl_id = 1")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between pages, one for each row of lineitem, in order of edge_seq."""
    n = n_pages(spark, sf_dir)
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % n).cast("long").alias("from_id"), (F.col("l_partkey") % n).cast("long").alias("to_id"),
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).cast("long").alias("edge_seq"), (F.col("l_linenumber") == 7).alias("nofollow"),
        F.concat("l_returnflag", "l_linestatus").alias("anchor"),
    )


def crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("crawl_id"), (F.col("o_custkey") % 20).cast("long").alias("site_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
        (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 1 HOUR")).alias("finished_at"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'failed' ELSE 'running' END").alias("status"),
        (F.floor("o_totalprice").cast("long") % 101).alias("health_score"),
    )


KIND = "CASE event_type WHEN 'click' THEN 'status_changed' WHEN 'view' THEN 'new_url' WHEN 'error' THEN 'error_spike' WHEN 'signup' THEN 'title_changed' ELSE 'became_noindex' END"
SEVERITY = "CASE user_id % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'notice' END"


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("change_id"), (F.col("user_id") % 20).cast("long").alias("site_id"), F.col("ts").cast("timestamp").alias("created_at"),
        F.expr(KIND).alias("kind"), F.expr(SEVERITY).alias("severity"),
    )
