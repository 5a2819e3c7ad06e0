"""Link graph, redirects, sitemaps and differences of snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import crawl
from pagewright.operators import graph as G
from pagewright.plans.fixtures import BASE, crawl_pages, current, edges, n_pages, previous
from pagewright.plans.registry import query
from pagewright.session import cut_lineage

_BFS = """, walk AS (SELECT CAST(0 AS BIGINT) AS page_id, 0 AS depth UNION SELECT e.to_id, w.depth + 1 FROM walk w JOIN edges e ON e.from_id = w.page_id WHERE NOT e.nofollow AND w.depth < 12),
depths AS (SELECT page_id, min(depth) AS depth FROM walk GROUP BY 1),
parents AS (SELECT e.to_id AS page_id, arg_min(e.from_id, e.edge_seq) AS parent_id FROM edges e JOIN depths a ON a.page_id = e.from_id JOIN depths b ON b.page_id = e.to_id WHERE NOT e.nofollow AND b.depth = a.depth + 1 GROUP BY 1)
"""
_BAD = "(status >= 400 OR error IS NOT NULL)"


@query("w6", BASE + f"SELECT DISTINCT from_id, to_id, edge_seq FROM (SELECT *, row_number() OVER (PARTITION BY to_id ORDER BY edge_seq) AS r FROM edges) WHERE r <= 20 OR to_id IN (SELECT page_id FROM cur WHERE {_BAD} OR status BETWEEN 300 AND 399)")
def w6(spark, sf_dir):
    problem = current(spark, sf_dir).where(f"{_BAD} OR status BETWEEN 300 AND 399").select("page_id")
    return G.inlink_samples(edges(spark, sf_dir), problem)


@query("snk2", BASE + f"SELECT e.to_id, e.from_id, min(e.edge_seq) AS edge_seq FROM edges e JOIN cur t ON t.page_id = e.to_id WHERE {_BAD.replace('status', 't.status').replace('error', 't.error')} GROUP BY ALL")
def snk2(spark, sf_dir):
    """Links to broken pages, one per pair."""
    bad = current(spark, sf_dir).where(_BAD).select(F.col("page_id").alias("to_id"))
    return edges(spark, sf_dir).join(bad, "to_id", "left_semi").groupBy("to_id", "from_id").agg(F.min("edge_seq").alias("edge_seq"))


@query("w7", BASE + "SELECT from_id, to_id, (array_agg(anchor ORDER BY edge_seq, anchor))[1] AS anchor, bool_and(nofollow) AS nofollow FROM edges GROUP BY ALL")
def w7(spark, sf_dir):
    return G.distinct_links(edges(spark, sf_dir)).select("from_id", "to_id", "anchor", "nofollow")


@query("x6", BASE + "SELECT from_id AS page_id, count(DISTINCT to_id) AS outlinks, count(DISTINCT to_id) FILTER (nofollow) AS nofollow FROM edges GROUP BY 1")
def x6(spark, sf_dir):
    """Distinct targets of each page; counted over distinct rows, so that no page's links meet twice."""
    pairs = edges(spark, sf_dir).groupBy("from_id", "to_id").agg(F.bool_or("nofollow").alias("any"))
    return pairs.groupBy(F.col("from_id").alias("page_id")).agg(F.count("*").alias("outlinks"), F.count_if("any").alias("nofollow"))


@query("g1", BASE + _BFS + "SELECT page_id, depth FROM depths")
def g1(spark, sf_dir):
    return G.click_depth(edges(spark, sf_dir), 0)


@query("g2", BASE + _BFS + "SELECT page_id, parent_id FROM parents")
def g2(spark, sf_dir):
    links = edges(spark, sf_dir)
    return G.tree_parents(G.click_depth(links, 0), links)


def _crawl_sql(levels: int = 6, passes: int = 4) -> str:
    """The crawl in SQL: each level written out, with its redirects."""
    out = [
        "known AS (SELECT page_id, coalesce(meta_robots, '') <> 'noindex' AS follow, (SELECT min(t.page_id) FROM cur t WHERE t.url = cur.redirect_target) AS redirect_to, in_sitemap FROM cur)",
        "budget AS (SELECT count(*) * 4 // 5 AS b FROM known)",
        "links AS (SELECT from_id, to_id, min(edge_seq) AS edge_seq FROM edges WHERE NOT nofollow AND from_id IN (SELECT page_id FROM known WHERE follow AND redirect_to IS NULL) AND to_id IN (SELECT page_id FROM known) GROUP BY ALL)",
        "lv0 AS (SELECT CAST(0 AS BIGINT) AS page_id, 0 AS depth, CAST(NULL AS BIGINT) AS parent_id, 'start' AS found_by, CAST(1 AS BIGINT) AS place)",
        "seen0 AS (SELECT page_id, depth, parent_id, found_by FROM lv0)", "adm0 AS (SELECT CAST(1 AS BIGINT) AS n)",
    ]
    for d in range(levels):
        seen, heads = f"seen{d}", [f"SELECT *, 0 AS hop FROM lv{d}"]
        for h in range(passes):
            going = f"lv{d}" if h == 0 else f"hop{d}_{h - 1}"
            out.append(f"hop{d}_{h} AS (SELECT k.redirect_to AS page_id, {d} AS depth, arg_min(struct_pack(p := g.parent_id), (g.place, g.page_id)).p AS parent_id, 'redirect' AS found_by, min(g.place) AS place FROM {going} g JOIN known k ON k.page_id = g.page_id WHERE k.redirect_to NOT IN (SELECT page_id FROM {seen}) GROUP BY 1)")
            out.append(f"seen{d}_{h} AS (SELECT * FROM {seen} UNION ALL SELECT page_id, depth, parent_id, found_by FROM hop{d}_{h})")
            seen = f"seen{d}_{h}"
            heads.append(f"SELECT *, {h + 1} AS hop FROM hop{d}_{h}")
        out.append(f"next{d} AS (SELECT l.to_id AS page_id, arg_min(h.page_id, (h.place, h.hop, l.edge_seq)) AS parent_id, min((h.place, h.hop, l.edge_seq)) AS found FROM ({' UNION ALL '.join(heads)}) h JOIN links l ON l.from_id = h.page_id WHERE l.to_id NOT IN (SELECT page_id FROM {seen}) GROUP BY 1)")
        out.append(f"lv{d + 1} AS (SELECT * FROM (SELECT page_id, {d + 1} AS depth, parent_id, 'link' AS found_by, row_number() OVER (ORDER BY found, page_id) AS place FROM next{d}) WHERE place <= (SELECT b FROM budget) - (SELECT n FROM adm{d}))")
        out.append(f"adm{d + 1} AS (SELECT n + (SELECT count(*) FROM lv{d + 1}) AS n FROM adm{d})")
        out.append(f"seen{d + 1} AS (SELECT * FROM {seen} UNION ALL SELECT page_id, depth, parent_id, found_by FROM lv{d + 1})")
    out.append(f"rest AS (SELECT page_id, row_number() OVER (ORDER BY page_id) AS r FROM known WHERE in_sitemap AND page_id NOT IN (SELECT page_id FROM seen{levels}))")
    return BASE + ", " + ", ".join(out) + f" SELECT * FROM seen{levels} UNION ALL SELECT page_id, NULL, NULL, 'sitemap' FROM rest WHERE r <= (SELECT b FROM budget) - (SELECT n FROM adm{levels})"


@query("g1_budget", _crawl_sql())
def g1_budget(spark, sf_dir):
    """What a crawl of four fifths of the pages takes in, how deep and from where; redirects hand on depth and parent."""
    pages = current(spark, sf_dir).select("page_id", "url", "redirect_target", (F.coalesce("meta_robots", F.lit("")) != "noindex").alias("follow"), "in_sitemap")
    targets = pages.groupBy(F.col("url").alias("redirect_target")).agg(F.min("page_id").alias("redirect_to"))
    known = pages.join(targets, "redirect_target", "left").select("page_id", "follow", "redirect_to", "in_sitemap")
    return crawl.crawl_order(known, edges(spark, sf_dir), 0, known.count() * 4 // 5)


@query("g3")
def g3(spark, sf_dir):
    """Link score. Its sums depend on their order in the last digits; the tests compare it with numpy."""
    return G.link_score(current(spark, sf_dir), edges(spark, sf_dir))


@query("g4", BASE + "SELECT 'out' AS side, edge_seq, to_id AS other FROM edges WHERE from_id = 5 UNION ALL SELECT 'in', edge_seq, from_id FROM edges WHERE to_id = 5")
def g4(spark, sf_dir):
    rows = edges(spark, sf_dir)
    out = rows.where("from_id = 5").select(F.lit("out").alias("side"), "edge_seq", F.col("to_id").alias("other"))
    return out.unionByName(rows.where("to_id = 5").select(F.lit("in").alias("side"), "edge_seq", F.col("from_id").alias("other")))


@query("g5", BASE + _BFS + """, pairs AS (SELECT DISTINCT from_id, to_id FROM edges WHERE from_id <> to_id)
SELECT from_id, to_id FROM pairs p WHERE to_id <> 0 AND to_id NOT IN (SELECT to_id FROM pairs GROUP BY 1 HAVING (SELECT n FROM nn) >= 10 AND 2 * count(*) >= (SELECT n FROM nn))
 AND NOT EXISTS (SELECT 1 FROM parents t WHERE t.parent_id = p.from_id AND t.page_id = p.to_id)""")
def g5(spark, sf_dir):
    links = edges(spark, sf_dir)
    return G.without_navigation(links, G.tree_parents(G.click_depth(links, 0), links), 0, n_pages(spark, sf_dir))


@query("g6", BASE + """, chain AS (SELECT page_id, redirect_target AS at, 1 AS hops, [url, redirect_target] AS seen, redirect_target = url AS loops FROM cur WHERE redirect_target IS NOT NULL
 UNION ALL SELECT c.page_id, t.redirect_target, c.hops + 1, list_append(c.seen, t.redirect_target), list_contains(c.seen, t.redirect_target) FROM chain c JOIN cur t ON t.url = c.at WHERE t.redirect_target IS NOT NULL AND c.hops < 10 AND NOT c.loops)
SELECT c.page_id, CASE WHEN t.redirect_target IS NULL AND NOT loops THEN c.at END AS final_url, CASE WHEN t.redirect_target IS NULL AND NOT loops THEN t.status END AS final_status, c.hops,
 CASE WHEN loops THEN 'loop' WHEN t.redirect_target IS NOT NULL THEN 'too_many' END AS error
FROM chain c LEFT JOIN cur t ON t.url = c.at WHERE t.redirect_target IS NULL OR loops OR c.hops = 10""")
def g6(spark, sf_dir):
    """Where redirects end, or why they do not."""
    return G.redirect_ends(current(spark, sf_dir))


@query("j1", BASE + "SELECT p.page_id, p.canonical, t.status AS target_status FROM cur p LEFT JOIN cur t ON t.url = p.canonical WHERE p.canonical <> p.url")
def j1(spark, sf_dir):
    pages = current(spark, sf_dir)
    target = pages.select(F.col("url").alias("canonical"), F.col("status").alias("target_status"))
    return pages.where("canonical <> url").select("page_id", "canonical").join(target, "canonical", "left")


@query("j2", BASE + f"SELECT e.from_id AS page_id, count(DISTINCT e.to_id) AS broken_targets FROM edges e JOIN cur t ON t.page_id = e.to_id WHERE {_BAD.replace('status', 't.status').replace('error', 't.error')} GROUP BY 1")
def j2(spark, sf_dir):
    bad = current(spark, sf_dir).where(_BAD).select(F.col("page_id").alias("to_id"))
    pairs = edges(spark, sf_dir).select("from_id", "to_id").distinct().join(bad, "to_id", "left_semi")
    return pairs.groupBy(F.col("from_id").alias("page_id")).agg(F.count("*").alias("broken_targets"))


_WORDS = "list_filter(string_split(lower(path), '/'), lambda w: w <> '')"


@query("j21", BASE + f""", w AS (SELECT page_id, host, regexp_extract(path, '^/([^/]+)/', 1) AS folder, {_WORDS} AS words, status, error, html_ok FROM cur),
s AS (SELECT b.page_id, g.page_id AS stand_in, len(list_intersect(b.words, g.words)) AS shared FROM w b JOIN w g ON g.folder = b.folder AND g.host = b.host WHERE (b.status >= 400 OR b.error IS NOT NULL) AND g.html_ok AND b.folder <> '')
SELECT page_id, stand_in FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY shared DESC, stand_in) AS r FROM s) WHERE r = 1""")
def j21(spark, sf_dir):
    """The best stand-in for a broken page: the page of its folder and host that shares most path words."""
    folder = F.regexp_extract("path", "^/([^/]+)/", 1)
    rows = current(spark, sf_dir).select("page_id", "host", folder.alias("folder"), F.array_distinct(F.filter(F.split(F.lower("path"), "/"), lambda w: w != "")).alias("words"), F.expr(_BAD).alias("broken"), "html_ok")
    rows = cut_lineage(rows.where("folder <> '' AND (broken OR html_ok)"))
    return G.best_shared(rows.where("broken"), rows.where("html_ok"), ["host", "folder"])


@query("j22", BASE + _BFS + """, climb AS (SELECT page_id, parent_id AS above, 1 AS up FROM parents UNION ALL SELECT c.page_id, p.parent_id, c.up + 1 FROM climb c JOIN parents p ON p.page_id = c.above WHERE c.up < 12)
SELECT page_id, arg_min(above, up) AS hub FROM climb WHERE above % 5 = 0 GROUP BY 1""")
def j22(spark, sf_dir):
    """The nearest ancestor of each page that is a hub (here: an id divisible by five), up the tree."""
    links = edges(spark, sf_dir)
    parents = cut_lineage(G.tree_parents(G.click_depth(links, 0), links))
    return G.nearest_above(parents, F.col("at") % 5 == 0).withColumnRenamed("above", "hub")


_BUCKET = "CASE WHEN p.page_id IS NULL THEN 'not_crawled' WHEN p.status BETWEEN 300 AND 399 THEN 'redirect' WHEN p.status >= 400 OR p.error IS NOT NULL THEN 'error' WHEN p.indexability = 'noindex' THEN 'noindex' WHEN p.indexability = 'canonicalised' THEN 'canonicalised' ELSE 'ok' END"
_URLS = ", urls AS (SELECT DISTINCT 3 + page_id % 3 AS file, url FROM p0 WHERE page_id % 3 <> 0)"


@query("j6", BASE + _URLS + f"SELECT u.file, {_BUCKET} AS bucket, count(*) AS urls FROM urls u LEFT JOIN cur p ON p.url = u.url GROUP BY ALL")
def j6(spark, sf_dir):
    """What the crawl found for the URLs of each sitemap file."""
    return _classified(spark, sf_dir).groupBy("file", "bucket").agg(F.count("*").alias("urls"))


def _classified(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/pages.parquet").where("page_id % 3 <> 0")
    urls = raw.select((3 + F.col("page_id") % 3).alias("file"), F.regexp_replace("url", "#.*$", "").alias("url")).distinct()
    p = current(spark, sf_dir).select("url", "page_id", "status", "error", "indexability").alias("p")
    return urls.join(p, "url", "left").select("file", "url", F.expr(_BUCKET).alias("bucket"))


@query("x10", BASE + "SELECT page_id % 3 AS file, count(lm) AS with_date, count(DISTINCT lm) AS dates, min(lm) AS first, max(lm) AS last, count(*) FILTER (lm > '2024-06-01') AS future FROM (SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN concat('2024-0', CAST(1 + page_id % 8 AS VARCHAR), '-1', CAST(page_id % 7 AS VARCHAR)) END AS lm FROM cur) GROUP BY 1")
def x10(spark, sf_dir):
    """Last modification dates of sitemap entries."""
    lm = F.when(F.col("page_id") % 4 != 0, F.concat(F.lit("2024-0"), (1 + F.col("page_id") % 8).cast("string"), F.lit("-1"), (F.col("page_id") % 7).cast("string")))
    rows = current(spark, sf_dir).select((F.col("page_id") % 3).alias("file"), lm.alias("lm"))
    return rows.groupBy("file").agg(F.count("lm").alias("with_date"), F.count_distinct("lm").alias("dates"), F.min("lm").alias("first"), F.max("lm").alias("last"), F.count_if(F.col("lm") > "2024-06-01").alias("future"))


_ERR = "({0}.status >= 400 OR {0}.error IS NOT NULL)"
_DIFF = {
    "new_url": "q.url IS NULL", "removed_url": "p.url IS NULL", "status_changed": "p.status <> q.status",
    "became_noindex": "p.indexability = 'noindex' AND q.indexability <> 'noindex'", "title_removed": "trim(p.title) = '' AND trim(q.title) <> ''",
    "title_changed": "trim(p.title) <> '' AND trim(q.title) <> '' AND trim(p.title) <> trim(q.title)", "canonical_changed": "coalesce(p.canonical, 'none') <> coalesce(q.canonical, 'none')",
    "redirect_chain_grew": "p.hops > q.hops",
}
_BASE_RANK = {"new_url": "2", "removed_url": "2", "status_changed": f"CASE WHEN {_ERR.format('p')} AND NOT {_ERR.format('q')} THEN 1 ELSE 2 END", "became_noindex": "1", "title_removed": "1", "title_changed": "2", "canonical_changed": "2", "redirect_chain_grew": "2"}
_KEY = "coalesce(p.page_id, q.page_id) IN (0, 3, 30)"
_SIDE = {"new_url": "true", "removed_url": "true"}


def _diff_rows(kind: str) -> str:
    both = _SIDE.get(kind, "p.url IS NOT NULL AND q.url IS NOT NULL")
    return f"CASE WHEN ({both}) AND ({_DIFF[kind]}) THEN greatest(0, ({_BASE_RANK[kind]}) - CASE WHEN {_KEY} THEN 1 ELSE 0 END) END"


@query("d1", BASE + ", j AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, coalesce(p.url, q.url) AS url, {_diff_rows(k)} AS rank FROM cur p FULL JOIN prv q ON p.url = q.url" for k in _DIFF) + ") SELECT kind, url, CASE rank WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'notice' END AS severity FROM j WHERE rank IS NOT NULL")
def d1(spark, sf_dir):
    """Changes between two crawls; those of key pages weigh one step more. One full join makes all kinds."""
    cols = ["page_id", "url", "status", "error", "indexability", "title", "canonical", "hops"]
    p, q = current(spark, sf_dir).select(cols).alias("p"), previous(spark, sf_dir).select(cols).alias("q")
    both = p.join(q, F.col("p.url") == F.col("q.url"), "full")
    made = F.array(*(F.struct(F.lit(k).alias("kind"), F.expr(_diff_rows(k)).alias("rank")) for k in _DIFF))
    rows = both.select(F.coalesce("p.url", "q.url").alias("url"), F.explode(F.filter(made, lambda c: c["rank"].isNotNull())).alias("c"))
    return rows.select("c.kind", "url", F.expr("CASE c.rank WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'notice' END").alias("severity"))


@query("j5", BASE + "SELECT coalesce(p.page_id, q.page_id) AS page_id, p.url IS NOT NULL AS now, q.url IS NOT NULL AS before FROM cur p FULL JOIN (SELECT *, regexp_replace(url, '^http:', 'https:') AS moved FROM prv) q ON regexp_replace(p.url, '^http:', 'https:') = q.moved")
def j5(spark, sf_dir):
    """Snapshots matched by address after a move of the scheme."""
    moved = lambda df, s: df.select(F.regexp_replace("url", "^http:", "https:").alias("moved"), F.col("page_id").alias(s))
    both = moved(current(spark, sf_dir), "p").join(moved(previous(spark, sf_dir), "q"), "moved", "full")
    return both.select(F.coalesce("p", "q").alias("page_id"), F.col("p").isNotNull().alias("now"), F.col("q").isNotNull().alias("before"))


@query("d2", BASE + f"SELECT count(*) AS newly_failing, greatest(3, CAST(ceil(0.02 * (SELECT count(*) FROM cur)) AS BIGINT)) AS bound, count(*) >= greatest(3, CAST(ceil(0.02 * (SELECT count(*) FROM cur)) AS BIGINT)) AS spike FROM cur p JOIN prv q ON p.url = q.url WHERE {_ERR.format('p')} AND NOT {_ERR.format('q')}")
def d2(spark, sf_dir):
    """Error spike: pages that fail anew, against two percent of all and three at least."""
    p = current(spark, sf_dir).select("url", F.expr(_BAD).alias("now"))
    # Earlier pages are counted by address first: where pages share one, each later page still is one page.
    q = previous(spark, sf_dir).groupBy("url").agg(F.count_if(~F.expr(_BAD)).alias("well"))
    one = p.join(q, "url", "left").agg(F.coalesce(F.sum(F.when(F.col("now"), F.col("well"))), F.lit(0)).alias("newly_failing"), F.count("*").alias("pages"))
    bound = F.greatest(F.lit(3), F.ceil(0.02 * F.col("pages")))
    return one.select("newly_failing", bound.alias("bound"), (F.col("newly_failing") >= bound).alias("spike"))


@query("d4", BASE + "SELECT a.n AS before, b.n AS now, b.n <= 0.9 * a.n AS shrank FROM (SELECT count(*) FILTER (in_sitemap) AS n FROM prv) a, (SELECT count(*) FILTER (in_sitemap AND page_id % 8 <> 1) AS n FROM cur) b")
def d4(spark, sf_dir):
    """Whether the sitemap lost a tenth of its addresses."""
    one = crawl_pages(spark, sf_dir).agg(F.count_if(F.expr("crawl_id = 1 AND in_sitemap")).alias("before"), F.count_if(F.expr("crawl_id = 2 AND in_sitemap AND page_id % 8 <> 1")).alias("now"))
    return one.select("before", "now", (F.col("now") <= 0.9 * F.col("before")).alias("shrank"))


@query("j20", BASE + "SELECT page_id FROM cur WHERE html_ok AND page_id % 6 <> 0 ORDER BY inlinks DESC, page_id LIMIT 15")
def j20(spark, sf_dir):
    """The most linked pages that a listing (here: ids divisible by six) leaves out."""
    pages = current(spark, sf_dir)
    listed = pages.where("page_id % 6 = 0").select("page_id")
    return pages.where("html_ok").join(listed, "page_id", "left_anti").orderBy(F.desc("inlinks"), "page_id").limit(15).select("page_id")


@query("v8", BASE + "SELECT page_id % 7 AS folder, CASE WHEN count(*) FILTER (indexability <> 'indexable') = count(*) THEN 'all' WHEN 2 * count(*) FILTER (indexability <> 'indexable') > count(*) THEN 'most' ELSE 'some' END AS hint FROM cur GROUP BY 1")
def v8(spark, sf_dir):
    """Hints of groups of pages: all, most or some of them closed to the index."""
    rows = current(spark, sf_dir).groupBy((F.col("page_id") % 7).alias("folder")).agg(F.count_if(F.col("indexability") != "indexable").alias("closed"), F.count("*").alias("n"))
    return rows.select("folder", F.when(F.col("closed") == F.col("n"), "all").when(2 * F.col("closed") > F.col("n"), "most").otherwise("some").alias("hint"))


@query("t9")
def t9(spark, sf_dir):
    """A graph cut to fit 5,000 pages: the root, then the pages of the best link scores together with all their ancestors."""
    pages = cut_lineage(current(spark, sf_dir).select("page_id"))
    links = edges(spark, sf_dir)
    crawled = G.targets(links, pages)
    parents = cut_lineage(G.tree_parents(G.levels(crawled, 0), links))
    scores = G.scored(crawled).select("page_id", "score")
    crawled.unpersist()
    return G.kept_pages(scores, parents, 0, 5000)
