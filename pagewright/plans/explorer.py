"""Filters, searches, pages, counts, top lists of a crawl."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagewright.operators import explore as X
from pagewright.plans.fixtures import BASE, changes, crawl_pages, crawls, current, edges, previous
from pagewright.plans.registry import query
from pagewright.sources.writers import fitted

_HTML, _IMG = "coalesce(content_type,'') ILIKE 'text/html%'", "coalesce(content_type,'') ILIKE 'image/%'"
_FILTERS = {
    "all": "true", "s2": "status BETWEEN 200 AND 299", "s3": "status BETWEEN 300 AND 399", "s4": "status BETWEEN 400 AND 499", "s5": "status BETWEEN 500 AND 599",
    "s0": "status = 0", "ix": "indexability = 'indexable'", "nx": "indexability <> 'indexable'", "html": _HTML, "img": _IMG, "oth": f"NOT ({_HTML} OR {_IMG})",
}


@query("p1", BASE + " UNION ALL ".join(f"SELECT '{k}' AS filter, page_id FROM cur WHERE {p}" for k, p in _FILTERS.items()))
def p1(spark, sf_dir):
    """All filters at once: a page with the keys of the filters that it passes."""
    keys = [F.when(X.page_filter(k), F.lit(k)) for k in _FILTERS]
    return current(spark, sf_dir).select(F.explode(F.array_compact(F.array(*keys))).alias("filter"), "page_id")


@query("p2", BASE + f"SELECT page_id, content_type FROM cur WHERE NOT ({_HTML} OR {_IMG})")
def p2(spark, sf_dir):
    return current(spark, sf_dir).where(X.page_filter("oth")).select("page_id", "content_type")


@query("p3", BASE + "SELECT page_id FROM cur WHERE (((CASE WHEN status BETWEEN 400 AND 499 THEN 1 ELSE 0 END) | (CASE WHEN status BETWEEN 500 AND 599 THEN 2 ELSE 0 END)) & 2) <> 0")
def p3(spark, sf_dir):
    from pagewright.operators.checks import mask, page_checks

    flags = {s: c for s, c in page_checks().items() if s in ("http_4xx", "http_5xx")}
    return current(spark, sf_dir).select("page_id", mask(flags).alias("issues")).where(X.page_filter("check:http_5xx")).select("page_id")


@query("p4", BASE + "SELECT page_id, url, title FROM cur WHERE url ILIKE '%/EN/%' OR title ILIKE '%/EN/%'")
def p4(spark, sf_dir):
    return X.search(current(spark, sf_dir), "/EN/").select("page_id", "url", "title")


@query("x16", BASE + "SELECT page_id, url FROM cur WHERE url ILIKE '%utm\\_source%' ESCAPE '\\'")
def x16(spark, sf_dir):
    """Search for text with a wildcard of LIKE in it."""
    return X.search(current(spark, sf_dir).withColumn("title", F.lit("")), "utm_source").select("page_id", "url")


@query("p5", BASE + "SELECT page_id, url, status FROM cur WHERE page_id > 40 ORDER BY page_id LIMIT 25")
def p5(spark, sf_dir):
    return X.page_of_rows(current(spark, sf_dir), 40, 25).select("page_id", "url", "status")


@query("p6", BASE + "SELECT page_id, status FROM cur WHERE status >= 400 OR error IS NOT NULL ORDER BY page_id DESC LIMIT 20")
def p6(spark, sf_dir):
    """Newest live rows with errors."""
    return current(spark, sf_dir).where("status >= 400 OR error IS NOT NULL").orderBy(F.desc("page_id")).limit(20).select("page_id", "status")


@query("p7", BASE + "SELECT change_id, kind FROM changes WHERE severity = 'critical'")
def p7(spark, sf_dir, severity: str | None = "critical"):
    rows = changes(spark, sf_dir)
    return (rows if severity is None else rows.where(F.col("severity") == severity)).select("change_id", "kind")


@query("p8", BASE + "SELECT page_id, url FROM cur WHERE page_id IN (0, 3, 5, 7, 11, 99)")
def p8(spark, sf_dir):
    return current(spark, sf_dir).where(F.col("page_id").isin(0, 3, 5, 7, 11, 99)).select("page_id", "url")


@query("p9", BASE + "SELECT kind, severity, count(*) AS n FROM changes WHERE severity = 'critical' OR (kind = 'error_spike' AND severity <> 'notice') GROUP BY ALL")
def p9(spark, sf_dir):
    """Gate: critical findings, and error spikes from warning on."""
    gates = ["critical", "error_spike:warning"]
    rank = F.expr("CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END")
    hit = F.lit(False)
    for g in gates:
        kind, _, least = g.rpartition(":")
        at_least = rank <= {"critical": 0, "warning": 1, "notice": 2}[least]
        hit = hit | (at_least & (F.col("kind") == kind) if kind else at_least)
    return changes(spark, sf_dir).where(hit).groupBy("kind", "severity").agg(F.count("*").alias("n"))


@query("src2", BASE + "SELECT page_id, url, title, h1, word_count, indexability FROM cur WHERE page_id = 5")
def src2(spark, sf_dir):
    return current(spark, sf_dir).where("page_id = 5").select("page_id", "url", "title", "h1", "word_count", "indexability")


@query("src5", BASE + "SELECT site_id, crawl_id, finished_at FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY finished_at DESC, crawl_id DESC) AS r FROM crawls WHERE status = 'done') WHERE r = 1")
def src5(spark, sf_dir):
    """The newest finished crawl of each site; maxima are taken before the shuffle."""
    rows = crawls(spark, sf_dir).where("status = 'done'").groupBy("site_id").agg(F.max(F.struct("finished_at", "crawl_id")).alias("top"))
    return rows.select("site_id", "top.crawl_id", "top.finished_at")


@query("src6", BASE + "SELECT page_id, url, status, indexability, canonical FROM cur ORDER BY page_id LIMIT 20000")
def src6(spark, sf_dir):
    """Every page of the newest crawl, as the policy rules read it; its SQL stops at 20,000 pages."""
    return current(spark, sf_dir).select("page_id", "url", "status", "indexability", "canonical").orderBy("page_id")


@query("src6_inlinks")
def src6_inlinks(spark, sf_dir):
    """Links to redirecting pages for the rule of preferred addresses: 20,000 at most, and whether that many were read."""
    from pagewright.operators.graph import redirect_inlinks

    return redirect_inlinks(current(spark, sf_dir), edges(spark, sf_dir))


@query("src7", BASE + "SELECT page_id, CASE WHEN status BETWEEN 200 AND 299 THEN 'parsed' WHEN status = 429 OR status >= 500 OR status = 0 THEN 'all_blocked' WHEN status BETWEEN 400 AND 499 THEN 'no_rules' ELSE 'blocked' END AS crawler, CASE WHEN status BETWEEN 200 AND 299 THEN 'parsed' WHEN status = 429 OR status >= 500 OR status = 0 THEN 'all_blocked' ELSE 'no_rules' END AS report FROM cur")
def src7(spark, sf_dir):
    """What a robots.txt answer of a status means to the crawler and to the access report."""
    from pagewright.operators.robots import fetch_state

    return current(spark, sf_dir).select("page_id", fetch_state(F.col("status"), True).alias("crawler"), fetch_state(F.col("status"), False).alias("report"))


@query("a5", BASE + """SELECT count(*) AS pages, count(*) FILTER (indexability = 'indexable') AS indexable, count(*) FILTER (status BETWEEN 200 AND 299) AS s2,
 count(*) FILTER (status BETWEEN 300 AND 399) AS s3, count(*) FILTER (status BETWEEN 400 AND 499) AS s4, count(*) FILTER (status >= 500) AS s5, count(*) FILTER (depth IS NULL) AS no_depth,
 coalesce(CAST(floor(sum(response_ms) FILTER (status <> 0) / nullif(count(*) FILTER (status <> 0), 0)) AS BIGINT), 0) AS avg_ms FROM cur""")
def a5(spark, sf_dir):
    s, live = F.col("status"), F.col("status") != 0
    return current(spark, sf_dir).agg(
        F.count("*").alias("pages"), F.count_if(F.col("indexability") == "indexable").alias("indexable"), F.count_if(s.between(200, 299)).alias("s2"),
        F.count_if(s.between(300, 399)).alias("s3"), F.count_if(s.between(400, 499)).alias("s4"), F.count_if(s >= 500).alias("s5"), F.count_if(F.expr("depth IS NULL")).alias("no_depth"),
        F.coalesce(F.floor(F.sum(F.when(live, F.col("response_ms"))) / F.nullif(F.count_if(live), F.lit(0))), F.lit(0)).alias("avg_ms"),
    )


@query("a5_depths", BASE + "SELECT CASE WHEN depth >= 10 THEN '10+' ELSE CAST(depth AS VARCHAR) END AS depth, count(*) AS pages FROM cur WHERE depth IS NOT NULL GROUP BY 1")
def a5_depths(spark, sf_dir):
    depth = F.when(F.col("depth") >= 10, "10+").otherwise(F.col("depth").cast("string"))
    return current(spark, sf_dir).where("depth IS NOT NULL").groupBy(depth.alias("depth")).agg(F.count("*").alias("pages"))


@query("a6", BASE + "SELECT " + ", ".join(f"count(*) FILTER ({p}) AS f_{k}" for k, p in _FILTERS.items()) + " FROM cur")
def a6(spark, sf_dir):
    """The count of every filter in one pass."""
    return current(spark, sf_dir).agg(*(F.count_if(X.page_filter(k)).alias(f"f_{k}") for k in _FILTERS))


@query("a7", BASE + "SELECT count(*) FILTER (status BETWEEN 400 AND 499) AS matching, count(*) AS total FROM cur")
def a7(spark, sf_dir):
    return current(spark, sf_dir).agg(F.count_if(X.page_filter("s4")).alias("matching"), F.count("*").alias("total"))


_OVERLAP = {
    "listed": "in_sitemap", "unlisted": "NOT in_sitemap", "listed_ok": "in_sitemap AND status BETWEEN 200 AND 299", "listed_redirect": "in_sitemap AND status BETWEEN 300 AND 399",
    "listed_error": "in_sitemap AND (status >= 400 OR error IS NOT NULL)", "listed_noindex": "in_sitemap AND indexability = 'noindex'", "listed_canonicalised": "in_sitemap AND indexability = 'canonicalised'",
    "listed_blocked": "in_sitemap AND indexability = 'blocked_by_robots'", "listed_orphan": "in_sitemap AND depth IS NULL", "listed_indexable": "in_sitemap AND indexability = 'indexable'",
    "unlisted_indexable": "NOT in_sitemap AND indexability = 'indexable'", "unlisted_deep": "NOT in_sitemap AND depth > 3", "linked_listed": "in_sitemap AND inlinks > 0",
}


@query("a8", BASE + "SELECT " + ", ".join(f"count(*) FILTER ({p}) AS {k}" for k, p in _OVERLAP.items()) + " FROM cur")
def a8(spark, sf_dir):
    """Overlap of sitemap and crawl."""
    return current(spark, sf_dir).agg(*(F.count_if(F.expr(p)).alias(k) for k, p in _OVERLAP.items()))


@query("a9", BASE + "SELECT depth, count(*) AS pages, count(*) FILTER (indexability = 'indexable') AS indexable FROM cur GROUP BY depth")
def a9(spark, sf_dir):
    return current(spark, sf_dir).groupBy("depth").agg(F.count("*").alias("pages"), F.count_if(F.expr("indexability = 'indexable'")).alias("indexable")).orderBy(F.asc_nulls_last("depth"))


_FOLDER = "regexp_extract(path, '^/([^/]+)/', 1)"


@query("a10", BASE + f"SELECT {_FOLDER} AS folder, " + ", ".join(f"count(*) FILTER (least(depth, 4) = {d}) AS d{d}" for d in range(1, 5)) + " FROM cur WHERE depth >= 1 GROUP BY 1")
def a10(spark, sf_dir):
    """Pages by folder and depth; the columns are known, so one pass makes the pivot."""
    rows = current(spark, sf_dir).where("depth >= 1").withColumn("d", F.least("depth", F.lit(4)))
    return rows.groupBy(X.top_folder(F.col("path")).alias("folder")).agg(*(F.count_if(F.col("d") == d).alias(f"d{d}") for d in range(1, 5)))


@query("a11", BASE + f"SELECT {_FOLDER} AS folder, count(*) AS pages FROM cur GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def a11(spark, sf_dir):
    return current(spark, sf_dir).groupBy(X.top_folder(F.col("path")).alias("folder")).agg(F.count("*").alias("pages")).orderBy(F.desc("pages"), "folder").limit(10)


@query("x13", BASE + f"SELECT page_id, {_FOLDER} AS folder FROM cur")
def x13(spark, sf_dir):
    return current(spark, sf_dir).select("page_id", X.top_folder(F.col("path")).alias("folder"))


@query("j3", BASE + "SELECT p.page_id, p.url, p.redirect_target, t.status AS target_status FROM cur p LEFT JOIN cur t ON t.url = p.redirect_target WHERE p.status BETWEEN 300 AND 399")
def j3(spark, sf_dir):
    """Redirects with the status of their target."""
    pages = current(spark, sf_dir)
    target = pages.select(F.col("url").alias("redirect_target"), F.col("status").alias("target_status"))
    return pages.where("status BETWEEN 300 AND 399").select("page_id", "url", "redirect_target").join(target, "redirect_target", "left")


@query("a12", BASE + "SELECT count(*) FILTER (p.status BETWEEN 300 AND 399) AS redirects, count(*) FILTER (p.status >= 400) AS broken, CAST(sum(p.inlinks) FILTER (p.status >= 400) AS BIGINT) AS links_to_broken, CAST(max(p.hops) AS BIGINT) AS longest, count(*) FILTER (p.status BETWEEN 300 AND 399 AND t.status >= 400) AS ends_broken FROM cur p LEFT JOIN cur t ON t.url = p.redirect_target")
def a12(spark, sf_dir):
    pages = current(spark, sf_dir)
    target = pages.select(F.col("url").alias("redirect_target"), F.col("status").alias("target_status"))
    return pages.join(target, "redirect_target", "left").agg(
        F.count_if(F.expr("status BETWEEN 300 AND 399")).alias("redirects"), F.count_if(F.expr("status >= 400")).alias("broken"), F.sum(F.when(F.col("status") >= 400, F.col("inlinks"))).cast("long").alias("links_to_broken"),
        F.max("hops").cast("long").alias("longest"), F.count_if(F.expr("status BETWEEN 300 AND 399 AND target_status >= 400")).alias("ends_broken"),
    )


@query("a13", BASE + "SELECT count(*) FILTER (response_ms < 200) AS fast, count(*) FILTER (response_ms >= 200 AND response_ms < 500) AS fair, count(*) FILTER (response_ms >= 500 AND response_ms < 1000) AS slow, count(*) FILTER (response_ms >= 1000) AS very_slow FROM cur WHERE status <> 0")
def a13(spark, sf_dir):
    ms = F.col("response_ms")
    return current(spark, sf_dir).where("status <> 0").agg(
        F.count_if(ms < 200).alias("fast"), F.count_if((ms >= 200) & (ms < 500)).alias("fair"), F.count_if((ms >= 500) & (ms < 1000)).alias("slow"), F.count_if(ms >= 1000).alias("very_slow")
    )


@query("a14", BASE + "SELECT kind, severity, count(*) AS n FROM changes GROUP BY ALL")
def a14(spark, sf_dir):
    return changes(spark, sf_dir).groupBy("kind", "severity").agg(F.count("*").alias("n"))


@query("a29", BASE + "SELECT round(avg(depth), 6) AS avg_clicks, round(count(*) FILTER (depth <= 3) / count(*)::DOUBLE, 6) AS within_3, count(*) FILTER (depth > 3) AS deep, CAST(max(depth) AS BIGINT) AS deepest FROM cur WHERE depth IS NOT NULL AND indexability = 'indexable'")
def a29(spark, sf_dir):
    rows = current(spark, sf_dir).where("depth IS NOT NULL AND indexability = 'indexable'")
    return rows.agg(F.round(F.avg("depth"), 6).alias("avg_clicks"), F.round(F.count_if(F.expr("depth <= 3")) / F.count("*"), 6).alias("within_3"), F.count_if(F.expr("depth > 3")).alias("deep"), F.max("depth").cast("long").alias("deepest"))


@query("a30", BASE + "SELECT count(*) AS pages, (SELECT count(*) FROM edges) AS links, count(*) FILTER (status >= 400 OR error IS NOT NULL) AS broken, count(*) FILTER (status BETWEEN 300 AND 399) AS redirects, count(*) FILTER (indexability = 'noindex') AS noindex, count(*) FILTER (in_sitemap AND depth IS NULL AND inlinks = 0) AS orphans, count(*) FILTER (depth > 3) AS deep FROM cur")
def a30(spark, sf_dir):
    one = current(spark, sf_dir).agg(
        F.count("*").alias("pages"), F.count_if(F.expr("status >= 400 OR error IS NOT NULL")).alias("broken"), F.count_if(F.expr("status BETWEEN 300 AND 399")).alias("redirects"),
        F.count_if(F.expr("indexability = 'noindex'")).alias("noindex"), F.count_if(F.expr("in_sitemap AND depth IS NULL AND inlinks = 0")).alias("orphans"), F.count_if(F.expr("depth > 3")).alias("deep"),
    )
    return one.crossJoin(F.broadcast(edges(spark, sf_dir).agg(F.count("*").alias("links"))))  # one row each


@query("t1", BASE + "SELECT page_id, url FROM (SELECT page_id, url FROM cur WHERE page_id = 0 UNION SELECT * FROM (SELECT page_id, url FROM cur ORDER BY inlinks DESC, url LIMIT 20) UNION SELECT page_id, url FROM cur WHERE page_id IN (3, 30))")
def t1(spark, sf_dir):
    """Key pages: home, the most linked, the starred."""
    rows = current(spark, sf_dir).select("page_id", "url", "inlinks")
    top = rows.orderBy(F.desc("inlinks"), "url").limit(20)
    return rows.where(F.col("page_id").isin(0, 3, 30)).unionByName(top).select("page_id", "url").distinct()


@query("t2", BASE + """SELECT page_id, url, reason FROM (SELECT page_id, url, reason, row_number() OVER (PARTITION BY url ORDER BY p) AS r, min(p) OVER (PARTITION BY url) AS mp, inlinks FROM (
 SELECT page_id, url, inlinks, 'home' AS reason, 0 AS p FROM cur WHERE page_id = 0 UNION ALL SELECT page_id, url, inlinks, 'linked', 1 FROM (SELECT * FROM cur ORDER BY inlinks DESC, url LIMIT 20)
 UNION ALL SELECT page_id, url, inlinks, 'starred', 2 FROM cur WHERE page_id IN (3, 30))) WHERE r = 1 ORDER BY mp, inlinks DESC, url LIMIT 60""")
def t2(spark, sf_dir):
    """Important pages: home first, the most linked, the starred, at most 60."""
    rows = current(spark, sf_dir).select("page_id", "url", "inlinks")
    some = lambda df, reason, p: df.select("page_id", "url", "inlinks", F.lit(reason).alias("reason"), F.lit(p).alias("p"))
    every = some(rows.where("page_id = 0"), "home", 0).unionByName(some(rows.orderBy(F.desc("inlinks"), "url").limit(20), "linked", 1)).unionByName(some(rows.where(F.col("page_id").isin(3, 30)), "starred", 2))
    first = every.withColumn("r", F.row_number().over(Window.partitionBy("url").orderBy("p"))).where("r = 1")
    return first.orderBy("p", F.desc("inlinks"), "url").limit(60).select("page_id", "url", "reason")


@query("t3", BASE + "SELECT page_id, depth, inlinks FROM cur WHERE indexability = 'indexable' AND depth >= 4 ORDER BY inlinks DESC, depth DESC, page_id LIMIT 25")
def t3(spark, sf_dir):
    return current(spark, sf_dir).where("indexability = 'indexable' AND depth >= 4").orderBy(F.desc("inlinks"), F.desc("depth"), "page_id").limit(25).select("page_id", "depth", "inlinks")


@query("t4", BASE + "SELECT page_id, status, inlinks FROM cur WHERE status >= 400 OR error IS NOT NULL ORDER BY inlinks DESC, page_id LIMIT 50")
def t4(spark, sf_dir):
    return current(spark, sf_dir).where("status >= 400 OR error IS NOT NULL").orderBy(F.desc("inlinks"), "page_id").limit(50).select("page_id", "status", "inlinks")


@query("t5", BASE + "SELECT page_id, path FROM cur WHERE path ILIKE '%en%' ORDER BY (path ILIKE '/en%') DESC, length(path), path, url LIMIT 8")
def t5(spark, sf_dir):
    """Search: prefixes first, then shorter paths."""
    rows = current(spark, sf_dir).where(F.col("path").ilike("%en%"))
    return rows.orderBy(F.desc(F.col("path").ilike("/en%")), F.length("path"), "path", "url").limit(8).select("page_id", "path")


@query("t6", BASE + "SELECT change_id, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, CASE kind WHEN 'new_url' THEN 1 WHEN 'status_changed' THEN 3 WHEN 'became_noindex' THEN 4 WHEN 'title_changed' THEN 6 ELSE 11 END, change_id) AS place FROM changes WHERE site_id = 3 ORDER BY 2 LIMIT 100")
def t6(spark, sf_dir):
    """Changes of one site in their order: severity, kind, id; the first hundred."""
    from pagewright.functions.dims import CHANGE_KINDS

    ordinal = F.array_position(F.array(*map(F.lit, CHANGE_KINDS)), F.col("kind"))
    rank = F.expr("CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END")
    top = changes(spark, sf_dir).where("site_id = 3").withColumn("o", ordinal).withColumn("rank", rank).orderBy("rank", "o", "change_id").limit(100)
    return top.select("change_id", F.row_number().over(Window.orderBy("rank", "o", "change_id")).cast("long").alias("place"))


@query("t8", BASE + "SELECT page_id, word_count FROM cur WHERE indexability = 'indexable' AND depth > 3 ORDER BY word_count DESC, page_id LIMIT 10")
def t8(spark, sf_dir):
    return current(spark, sf_dir).where("indexability = 'indexable' AND depth > 3").orderBy(F.desc("word_count"), "page_id").limit(10).select("page_id", "word_count")


@query("t10", BASE + "SELECT page_id, url FROM cur WHERE html_ok ORDER BY (page_id = 0) DESC, (page_id IN (3, 30)) DESC, inlinks DESC, url LIMIT 5")
def t10(spark, sf_dir):
    """Pages to probe: home, starred, most linked."""
    return current(spark, sf_dir).where("html_ok").orderBy(F.desc(F.col("page_id") == 0), F.desc(F.col("page_id").isin(3, 30)), F.desc("inlinks"), "url").limit(5).select("page_id", "url")


@query("j4", BASE + """SELECT coalesce(p.page_id, q.page_id) AS page_id, p.status AS now_status, q.status AS old_status, p.depth AS now_depth, q.depth AS old_depth
 FROM cur p FULL JOIN prv q ON p.url = q.url WHERE p.url IS NULL OR q.url IS NULL OR p.status <> q.status OR p.indexability <> q.indexability OR p.depth IS DISTINCT FROM q.depth""")
def j4(spark, sf_dir):
    """Pages that differ between two crawls."""
    cols = ["page_id", "url", "status", "indexability", "depth"]
    p, q = current(spark, sf_dir).select(cols).alias("p"), previous(spark, sf_dir).select(cols).alias("q")
    both = p.join(q, F.col("p.url") == F.col("q.url"), "full")
    differ = F.col("p.url").isNull() | F.col("q.url").isNull() | (F.col("p.status") != F.col("q.status")) | (F.col("p.indexability") != F.col("q.indexability")) | ~F.col("p.depth").eqNullSafe(F.col("q.depth"))
    return both.where(differ).select(
        F.coalesce("p.page_id", "q.page_id").alias("page_id"), F.col("p.status").alias("now_status"), F.col("q.status").alias("old_status"), F.col("p.depth").alias("now_depth"), F.col("q.depth").alias("old_depth")
    )


_CHANGE_KIND = {
    "removed": "p_url IS NULL", "new_orphan": "q_url IS NULL AND p_depth IS NULL", "new": "q_url IS NULL", "broke": "p_bad AND NOT q_bad", "fixed": "q_bad AND NOT p_bad",
    "lost_links": "p_inlinks = 0 AND q_inlinks > 0", "now_noindex": "p_ix = 'noindex' AND q_ix <> 'noindex'", "now_redirects": "p_ix = 'redirected' AND q_ix <> 'redirected'",
    "deeper": "p_depth > q_depth", "shallower": "p_depth < q_depth",
}
_CHANGE_CASE = "CASE " + " ".join(f"WHEN {p} THEN '{k}'" for k, p in _CHANGE_KIND.items()) + " END"


@query("d5", BASE + f"""SELECT page_id, {_CHANGE_CASE} AS change FROM (SELECT coalesce(p.page_id, q.page_id) AS page_id, p.url AS p_url, q.url AS q_url, p.depth AS p_depth, q.depth AS q_depth,
 p.status >= 400 OR p.error IS NOT NULL AS p_bad, q.status >= 400 OR q.error IS NOT NULL AS q_bad, p.inlinks AS p_inlinks, q.inlinks AS q_inlinks, p.indexability AS p_ix, q.indexability AS q_ix
 FROM cur p FULL JOIN prv q ON p.url = q.url) WHERE {_CHANGE_CASE} IS NOT NULL""")
def d5(spark, sf_dir):
    """What became of each page, by the first rule that holds."""
    side = lambda df, s: df.select("url", *(F.col(c).alias(f"{s}_{n}") for c, n in (("page_id", "id"), ("url", "url"), ("depth", "depth"), ("inlinks", "inlinks"), ("indexability", "ix"))), F.expr("status >= 400 OR error IS NOT NULL").alias(f"{s}_bad"))
    both = side(current(spark, sf_dir), "p").join(side(previous(spark, sf_dir), "q"), "url", "full")
    return both.select(F.coalesce("p_id", "q_id").alias("page_id"), F.expr(_CHANGE_CASE).alias("change")).where("change IS NOT NULL")


@query("x3", BASE + "SELECT page_id, regexp_replace(lower(host), '^www\\.', '') AS host_key, regexp_replace(lower(host), '^www\\.', '') = (SELECT min(regexp_replace(lower(host), '^www\\.', '')) FROM cur WHERE page_id = 0) AS internal FROM cur")
def x3(spark, sf_dir):
    """Host without www., and whether it is the root's."""
    pages = current(spark, sf_dir).select("page_id", X.host_key(F.col("host")).alias("host_key"))
    root = pages.where("page_id = 0").agg(F.min("host_key").alias("root"))
    return pages.crossJoin(F.broadcast(root)).select("page_id", "host_key", (F.col("host_key") == F.col("root")).alias("internal"))


@query("x5", BASE + "SELECT crawl_id, indexability, count(*) AS pages FROM cp GROUP BY ALL")
def x5(spark, sf_dir):
    return crawl_pages(spark, sf_dir).groupBy("crawl_id", "indexability").agg(F.count("*").alias("pages"))


@query("x14", BASE + "SELECT page_id FROM cur WHERE regexp_matches(path, '^/[a-z]+/.*5$') AND path LIKE '/en/%5'")
def x14(spark, sf_dir):
    """Pages that a glob matches."""
    return current(spark, sf_dir).where(X.glob_match(F.col("path"), F.lit(""), "/en/*5")).select("page_id")


@query("snk4", BASE + "SELECT page_id, CASE WHEN regexp_matches(concat(CASE WHEN page_id % 4 = 0 THEN '=' WHEN page_id % 4 = 1 THEN '-' ELSE '' END, title), '^[=+\\-@\\t\\r]') THEN concat('''', CASE WHEN page_id % 4 = 0 THEN '=' WHEN page_id % 4 = 1 THEN '-' ELSE '' END, title) ELSE title END AS title FROM cur")
def snk4(spark, sf_dir):
    """Cells of a CSV export, guarded against formulas."""
    cell = F.concat(F.expr("CASE WHEN page_id % 4 = 0 THEN '=' WHEN page_id % 4 = 1 THEN '-' ELSE '' END"), "title")
    return current(spark, sf_dir).select("page_id", X.guarded(cell).alias("title"))


@query("snk5", BASE + "SELECT kind, change_id FROM (SELECT kind, change_id, row_number() OVER (PARTITION BY kind ORDER BY change_id) AS r FROM changes) WHERE r <= 100")
def snk5(spark, sf_dir):
    """At most a hundred results per rule (a limit of the format); the group limit runs before the shuffle."""
    rows = changes(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("change_id")))
    return rows.where("r <= 100").select("kind", "change_id")


@query("snk8", BASE + """, s AS (SELECT site_id, change_id, kind, sum(length(kind) + 20) OVER (PARTITION BY site_id ORDER BY change_id) AS used FROM changes)
SELECT site_id, change_id, kind AS line FROM s WHERE used <= 1500 UNION ALL SELECT site_id, NULL, CAST(count(*) AS VARCHAR) || ' more' FROM s WHERE used > 1500 GROUP BY 1""")
def snk8(spark, sf_dir):
    """The first changes of each site's message that fit into its bytes, and how many more there are."""
    return fitted(changes(spark, sf_dir).select("site_id", "change_id", F.col("kind").alias("line")), "site_id", "change_id", 20, 1500)
