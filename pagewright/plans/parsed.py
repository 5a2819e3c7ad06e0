"""From html to checks and scores: pages written as markup, read by the parser, their links joined, and then judged.

The markup is made from the columns of the crawled pages: their titles, texts, metas and links stand in it as a site would write
them, and nothing but the markup and the answer's own columns goes on. The SQL side says what should come out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions.dims import BITS
from pagewright.operators import access as A
from pagewright.operators import checks as C
from pagewright.operators.parsed import page_table
from pagewright.plans.audit import ALL_SQL, _DIM
from pagewright.plans.fixtures import BASE, current, edges, table
from pagewright.plans.registry import query

#: Pages that hold nothing but a mount, a notice or scripts.
_BARE = "(page_id <> 0 AND (k % 10 = 0 OR k % 7 = 3))"


def _escaped(c):
    c = F.col(c) if isinstance(c, str) else c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def answers(spark, sf_dir):
    """What a crawler got of each page."""
    targets = table(spark, sf_dir, "pages").select(F.col("page_id").alias("to_id"), F.regexp_replace("url", "#.*$", "").alias("href"))
    rel = F.when(F.col("nofollow"), ' rel="external nofollow"').otherwise("")
    tag = F.concat(F.lit('<li><a href="'), _escaped("href"), F.lit('"'), rel, F.lit(">"), F.col("anchor"), F.lit("</a>"))
    # The links of one page, as they stand in its html.
    lists = edges(spark, sf_dir).join(targets, "to_id").groupBy(F.col("from_id").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("edge_seq", tag.alias("tag")))).alias("l"))
    lists = lists.select("page_id", F.array_join(F.transform("l", lambda x: x["tag"]), "").alias("list"))
    p = current(spark, sf_dir).join(lists, "page_id", "left")
    lit, e, when = F.lit, F.expr, F.when
    meta = lambda kind, name, c: when(F.col(c).isNotNull(), F.concat(lit(f'<meta {kind}="{name}" content="'), _escaped(c), lit('">'))).otherwise("")
    head = [
        F.concat(lit("<title>"), _escaped("title"), lit("</title>")), when(e("title_count = 2"), "<title>Second</title>").otherwise(""), meta("name", "Description", "description"),
        meta("name", "robots", "meta_robots"), meta("property", "og:title", "og_title"), meta("property", "og:image", "og_image"),
        when(e("canonical IS NOT NULL"), F.concat(lit('<link rel="canonical" href="'), _escaped("canonical"), lit('">'))).otherwise(""),
        when(e("hreflang_size > 0"), F.concat(lit('<link rel=alternate hreflang="de" href="'), when(e("hreflang_self"), _escaped("url")).otherwise("/de"), lit('"><link rel=alternate hreflang="en" href="/en">'))).otherwise(""),
        when(e("jsonld = 'valid'"), '<script type="application/ld+json">{"a": [1]}</script>').when(e("jsonld = 'invalid'"), '<script type="application/ld+json">{"a": </script>').otherwise(""),
        when(e("k % 3 = 0"), "<script src=/a.js></script>").otherwise("<script>var t = '</p>';</script>"),
    ]
    whole = F.concat(when(e("h1_count > 0"), F.concat(lit("<h1>"), _escaped("h1"), lit("</h1>"))).otherwise(""), when(e("h1_count > 1"), "<h1>Other</h1>").otherwise(""), lit("<p>"), _escaped("article"), lit("</p><ul>"), F.coalesce("list", lit("")), lit("</ul>"))
    bare = F.concat(when(e("k % 10 = 0"), "<div id=root></div>").otherwise(""), when(e("k % 7 = 3 AND k % 2 = 0"), "<noscript>Please enable  JavaScript</noscript>").otherwise(""))
    images = F.concat(F.repeat(lit("<img src=/i.png>"), F.col("images_missing_alt").cast("int")), F.repeat(lit('<img alt="" src="http://x.test/a.png">'), F.col("mixed_content").cast("int")))
    html = F.concat(lit("<!doctype html><html><head>"), *head, lit("</head><body>"), when(e(_BARE), bare).otherwise(whole), images)
    return p.select("page_id", "url", html.alias("html"), "status", "error", "content_type", "response_ms", "hops", "redirect_target", "in_sitemap", "k")


#: The page table that should come of it, under the names that the checks' SQL reads: cur and edges.
_WORDS = "CAST(len(regexp_extract_all({}, '[^ \\t\\n\\r]+')) AS BIGINT)"
_ONE = "trim(regexp_replace({}, '[ \\t\\n\\r]+', ' ', 'g'))"
_PARSED = f""", src AS (SELECT cur.* REPLACE (CASE WHEN {_BARE} THEN 0 ELSE h1_count END AS h1_count, CASE WHEN {_BARE} THEN '' ELSE article END AS article), {_BARE} AS bare FROM cur),
firsts AS (SELECT url, min(page_id) AS to_id FROM src GROUP BY 1),
written AS (SELECT e.from_id, e.edge_seq, e.nofollow, e.anchor, x.url FROM edges e JOIN src s ON s.page_id = e.from_id AND s.html_ok AND NOT s.bare JOIN p0 x ON x.page_id = e.to_id),
links AS (SELECT w.from_id, a.to_id, w.edge_seq, w.nofollow FROM written w JOIN firsts a USING (url)),
texts AS (SELECT from_id AS page_id, count(*) AS n, string_agg(anchor, ' ' ORDER BY edge_seq) AS anchors FROM written GROUP BY 1),
outs AS (SELECT from_id AS page_id, count(DISTINCT to_id) AS o FROM links WHERE from_id <> to_id GROUP BY 1),
nofs AS (SELECT from_id AS page_id, count(DISTINCT to_id) AS o FROM links WHERE from_id <> to_id AND nofollow GROUP BY 1),
ins AS (SELECT to_id AS page_id, count(DISTINCT from_id) AS i FROM links WHERE from_id <> to_id GROUP BY 1),
walk AS (SELECT CAST(0 AS BIGINT) AS page_id, 0 AS depth UNION SELECT l.to_id, w.depth + 1 FROM walk w JOIN links l ON l.from_id = w.page_id WHERE NOT l.nofollow AND w.depth < 12),
deep AS (SELECT page_id, min(depth) AS depth FROM walk GROUP BY 1),
heads AS (SELECT page_id, list_filter(CASE WHEN h1_count = 0 THEN [] WHEN h1_count = 1 THEN [substr({_ONE.format('h1')}, 1, 300)] ELSE [substr({_ONE.format('h1')}, 1, 300), 'Other'] END, lambda h: h <> '') AS hs FROM src),
page AS (SELECT s.page_id, s.url, s.status, s.error, s.response_ms, s.hops, s.in_sitemap, s.html_ok, s.k, d.depth, coalesce(i.i, 0) AS inlinks, coalesce(o.o, 0) AS outlinks_internal, coalesce(f.o, 0) AS outlinks_nofollow,
 CASE WHEN title_count = 2 AND trim(title) = '' THEN 'Second' ELSE substr({_ONE.format('title')}, 1, 1000) END AS title, title_count, description, hs[1] AS h1, len(hs) AS h1_count,
 CASE WHEN bare THEN 0 ELSE {_WORDS.format('s.article')} + CASE s.h1_count WHEN 0 THEN 0 WHEN 1 THEN {_WORDS.format('s.h1')} ELSE {_WORDS.format('s.h1')} + 1 END + coalesce(t.n, 0) END AS word_count,
 images_missing_alt, CASE WHEN s.html_ok AND s.url LIKE 'https://%' THEN mixed_content ELSE 0 END AS mixed_content, og_title, og_image, jsonld, hreflang_size, hreflang_self, CASE WHEN s.html_ok THEN canonical END AS canonical, s.html_ok AND has_noindex AS has_noindex,
 {_ONE.format("concat_ws(' ', CASE WHEN s.h1_count > 0 THEN s.h1 END, CASE WHEN s.h1_count > 1 THEN 'Other' END, s.article, CASE WHEN bare THEN NULL ELSE t.anchors END)")} AS article,
 bare AND s.k % 10 = 0 AS mount, bare AND s.k % 7 = 3 AND s.k % 2 = 0 AS notice
 FROM src s JOIN heads h USING (page_id) LEFT JOIN deep d USING (page_id) LEFT JOIN ins i USING (page_id) LEFT JOIN outs o USING (page_id) LEFT JOIN nofs f USING (page_id) LEFT JOIN texts t USING (page_id)),
judged AS (SELECT *, CASE WHEN status = 0 AND error IS NULL THEN 'blocked_by_robots' WHEN status < 200 OR status >= 500 THEN 'server_error' WHEN status BETWEEN 300 AND 399 THEN 'redirected' WHEN status BETWEEN 400 AND 499 THEN 'client_error' WHEN has_noindex THEN 'noindex'
 WHEN canonical IS NOT NULL AND canonical <> url THEN 'canonicalised' ELSE 'indexable' END AS indexability FROM page)
"""
_CHECKS = {s: p.replace("FROM cur WHERE", "FROM judged WHERE").replace("FROM cur t", "FROM judged t").replace("JOIN cur t", "JOIN judged t").replace("cur.", "judged.").replace("FROM edges e", "FROM links e") for s, p in ALL_SQL.items()}
_FAILED = BASE + _PARSED + ", failed AS (" + " UNION ALL ".join(f"SELECT page_id, {BITS[s]} AS bit FROM judged WHERE {p}" for s, p in _CHECKS.items()) + ")"


@query("pages_parsed", BASE + _PARSED + "SELECT page_id, depth, inlinks, outlinks_internal, outlinks_nofollow, CASE WHEN html_ok THEN word_count ELSE 0 END AS word_count, CASE WHEN html_ok THEN title END AS title, indexability FROM judged")
def pages_parsed(spark, sf_dir):
    """Fields and links of pages as their html says."""
    pages, _ = page_table(answers(spark, sf_dir), 0)
    return pages.select("page_id", "depth", "inlinks", "outlinks_internal", "outlinks_nofollow", F.col("word_count").cast("long").alias("word_count"), "title", "indexability")


@query("issues_parsed", _FAILED + "SELECT judged.page_id, CAST(coalesce(sum(1::BIGINT << bit), 0) AS BIGINT) AS issues FROM judged LEFT JOIN failed USING (page_id) GROUP BY ALL")
def issues_parsed(spark, sf_dir):
    """All checks of every page, from its html."""
    return C.issues(*page_table(answers(spark, sf_dir), 0))


@query("a2_parsed", _FAILED + _DIM + """, counts AS (SELECT d.*, count(*) AS affected FROM failed f JOIN dim d USING (bit) GROUP BY ALL),
lost AS (SELECT points * (0.25 + 0.75 * CASE WHEN scope = 'site_wide' THEN 1.0 ELSE least(1.0, affected / greatest(p.pages, 1)::DOUBLE) END) AS lost FROM counts, (SELECT count(*) AS pages FROM judged) p)
SELECT CAST(round(greatest(0, 100 - coalesce(sum(lost), 0))) AS INTEGER) AS health_score FROM lost""")
def a2_parsed(spark, sf_dir):
    """The health score, from html."""
    masks = issues_parsed(spark, sf_dir)
    return C.health_score(C.affected(masks), masks.agg(F.count("*").alias("pages")))


@query("f6_parsed", BASE + _PARSED + "SELECT CASE WHEN NOT html_ok OR word_count >= 50 THEN 'present' WHEN mount OR (notice AND h1_count = 0 AND (mount OR k % 3 = 0)) THEN 'shell' WHEN h1_count = 0 AND outlinks_internal = 0 AND k % 3 = 0 THEN 'likely_shell' ELSE 'thin' END AS content, count(*) AS pages FROM judged GROUP BY 1")
def f6_parsed(spark, sf_dir):
    """Pages by what they hold without scripts, from their html."""
    pages, _ = page_table(answers(spark, sf_dir), 0)
    state = A.content_state(F.col("html_ok"), F.col("word_count"), F.col("mount_empty"), F.col("script_notice"), F.col("h1_count") > 0, F.col("mount"), F.col("scripted"), F.col("outlinks_internal") > 0)
    return pages.groupBy(state.alias("content")).agg(F.count("*").alias("pages"))
