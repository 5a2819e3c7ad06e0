"""Checks, scores, and duplicates of a crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions.dims import BITS, CHECKS, SEVERITY_POINTS
from pagewright.operators import checks as C
from pagewright.plans.fixtures import BASE, current, edges, narrow
from pagewright.plans.registry import ORACLE, QUERIES, query

_OK = "html_ok"
_OPEN = "html_ok AND indexability = 'indexable'"
_LEN = "length(trim(coalesce({}, ''), ' \t\n\r'))"
_T, _D = _LEN.format("title"), _LEN.format("description")
#: The SQL side of the checks that one page decides.
PAGE_SQL = {
    "http_4xx": "status BETWEEN 400 AND 499",
    "http_5xx": "status BETWEEN 500 AND 599",
    "fetch_failed": "error IS NOT NULL AND error NOT IN ('redirect_loop', 'too_many_redirects')",
    "redirect_loop": "error IN ('redirect_loop', 'too_many_redirects')",
    "redirected": "status BETWEEN 300 AND 399 AND error IS NULL",
    "redirect_chain": "hops > 1",
    "noindex": "indexability = 'noindex'",
    "canonicalised": "indexability = 'canonicalised'",
    "canonical_missing": f"{_OPEN} AND canonical IS NULL",
    "blocked_by_robots": "indexability = 'blocked_by_robots'",
    "title_missing": f"{_OK} AND {_T} = 0",
    "title_too_long": f"{_OK} AND {_T} > 60",
    "title_too_short": f"{_OK} AND {_T} BETWEEN 1 AND 29",
    "title_multiple": f"{_OK} AND title_count > 1",
    "description_missing": f"{_OK} AND {_D} = 0",
    "description_too_long": f"{_OK} AND {_D} > 160",
    "description_too_short": f"{_OK} AND {_D} BETWEEN 1 AND 69",
    "h1_missing": f"{_OK} AND (h1_count = 0 OR {_LEN.format('h1')} = 0)",
    "h1_multiple": f"{_OK} AND h1_count > 1",
    "thin_content": f"{_OPEN} AND word_count < 200",
    "images_missing_alt": f"{_OK} AND images_missing_alt >= 1",
    "no_internal_outlinks": f"{_OK} AND outlinks_internal = 0",
    "nofollow_internal_links": f"{_OK} AND outlinks_nofollow > 0",
    "deep_page": "status BETWEEN 200 AND 299 AND depth > 3",
    "mixed_content": "url LIKE 'https://%' AND mixed_content > 0",
    "not_https": "url LIKE 'http://%' AND status BETWEEN 200 AND 299",
    "slow_response": "status <> 0 AND response_ms > 1000",
    "og_missing": f"{_OPEN} AND (trim(coalesce(og_title, '')) = '' OR trim(coalesce(og_image, '')) = '')",
    "jsonld_invalid": f"{_OK} AND jsonld = 'invalid'",
    "hreflang_missing_self": f"{_OK} AND hreflang_size > 0 AND NOT hreflang_self",
    "orphan": "in_sitemap AND depth IS NULL AND inlinks = 0",
    "sitemap_non_200": "in_sitemap AND status NOT BETWEEN 200 AND 299",
    "sitemap_noindex": "in_sitemap AND indexability = 'noindex'",
    "sitemap_canonicalised": "in_sitemap AND indexability = 'canonicalised'",
    "not_in_sitemap": "NOT in_sitemap AND indexability = 'indexable'",
}


def _shared(key: str) -> str:
    return f"page_id IN (SELECT page_id FROM (SELECT page_id, count(*) OVER (PARTITION BY {key}) AS c FROM cur WHERE {_OPEN} AND {key} <> '') WHERE c > 1)"


_BROKEN = "(t.status >= 400 OR t.error IS NOT NULL)"
SITE_SQL = {
    "title_duplicate": _shared("lower(trim(coalesce(title, '')))"),
    "description_duplicate": _shared("lower(trim(coalesce(description, '')))"),
    "h1_duplicate": _shared("lower(trim(coalesce(h1, '')))"),
    "content_duplicate": f"page_id IN (SELECT page_id FROM (SELECT page_id, count(*) OVER (PARTITION BY article) AS c FROM cur WHERE {_OPEN}) WHERE c > 1)",
    "canonical_to_non_200": "canonical <> url AND EXISTS (SELECT 1 FROM cur t WHERE t.url = cur.canonical AND t.status NOT BETWEEN 200 AND 299)",
    "links_to_broken": f"EXISTS (SELECT 1 FROM edges e JOIN cur t ON t.page_id = e.to_id WHERE e.from_id = cur.page_id AND {_BROKEN})",
    "links_to_redirect": f"EXISTS (SELECT 1 FROM edges e JOIN cur t ON t.page_id = e.to_id WHERE e.from_id = cur.page_id AND t.status BETWEEN 300 AND 399 AND NOT {_BROKEN})",
}
ALL_SQL = PAGE_SQL | SITE_SQL
#: One row per page and failed check.
FAILED = BASE + ", failed AS (" + " UNION ALL ".join(f"SELECT page_id, {BITS[s]} AS bit FROM cur WHERE {p}" for s, p in ALL_SQL.items()) + ")"
_DIM = ", dim AS (SELECT * FROM (VALUES " + ", ".join(f"({b}, '{s}', '{v}', '{c}', {SEVERITY_POINTS[v]})" for b, s, v, c in CHECKS) + ") t(bit, slug, severity, scope, points))"
COUNTED = FAILED + _DIM + """, counts AS (SELECT d.*, count(*) AS affected FROM failed f JOIN dim d USING (bit) GROUP BY ALL),
lost AS (SELECT counts.*, p.pages, points * (0.25 + 0.75 * CASE WHEN scope = 'site_wide' THEN 1.0 ELSE least(1.0, affected / greatest(p.pages, 1)::DOUBLE) END) AS lost
         FROM counts, (SELECT count(*) AS pages FROM cur) p)
"""


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.issues(narrow(spark, sf_dir), edges(spark, sf_dir))


def _one_check(slug: str):
    """Pages that fail one check; only the columns it needs are read."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pages = current(spark, sf_dir)
        own = C.page_checks() | C.sitemap_checks()
        if slug in own:
            return pages.where(own[slug]).select("page_id")
        return C.site_checks(narrow(spark, sf_dir), edges(spark, sf_dir)).where(F.getbit("issues", F.lit(BITS[slug])) == 1).select("page_id")

    return run


for _slug, _sql in ALL_SQL.items():
    QUERIES[f"check_{_slug}"] = _one_check(_slug)
    ORACLE[f"check_{_slug}"] = f"{BASE} SELECT page_id FROM cur WHERE {_sql}"


@query("issues", FAILED + "SELECT cur.page_id, CAST(coalesce(sum(1::BIGINT << bit), 0) AS BIGINT) AS issues FROM cur LEFT JOIN failed USING (page_id) GROUP BY ALL")
def all_issues(spark, sf_dir):
    return issues(spark, sf_dir)


_SITE_WIDE = """
SELECT 'robots_blocks_site' AS slug, count(*) FILTER (page_id = 0 AND indexability = 'blocked_by_robots') > 0 AS failed FROM cur
UNION ALL SELECT 'sitemap_missing', count(*) FILTER (in_sitemap) = 0 FROM cur
"""


@query("check_site_wide", BASE + _SITE_WIDE)
def site_wide(spark, sf_dir):
    one = current(spark, sf_dir).agg(
        (F.count_if((F.col("page_id") == 0) & (F.col("indexability") == "blocked_by_robots")) > 0).alias("robots_blocks_site"), (F.count_if("in_sitemap") == 0).alias("sitemap_missing")
    )
    return one.unpivot([], ["robots_blocks_site", "sitemap_missing"], "slug", "failed")


@query("a1", COUNTED + "SELECT bit, slug, severity, affected FROM counts")
def a1(spark, sf_dir):
    """Affected pages per check."""
    return C.affected(issues(spark, sf_dir)).select("bit", "slug", "severity", "affected")


@query("a2", COUNTED + "SELECT CAST(round(greatest(0, 100 - coalesce(sum(lost), 0))) AS INTEGER) AS health_score FROM lost")
def a2(spark, sf_dir):
    """Health score."""
    masks = issues(spark, sf_dir)
    return C.health_score(C.affected(masks), masks.agg(F.count("*").alias("pages")))


@query("a3", COUNTED + "SELECT slug, affected, round(greatest(0, 100 - (t - lost)) - greatest(0, 100 - t), 6) AS gain FROM lost, (SELECT sum(lost) AS t FROM lost)")
def a3(spark, sf_dir):
    """Points regained per check."""
    masks = issues(spark, sf_dir)
    return C.gains(C.affected(masks), masks.agg(F.count("*").alias("pages")))


@query("a4", COUNTED + """
SELECT f.page_id, round(sum(l.lost - l.points * CASE WHEN l.affected = 1 THEN 0 ELSE 0.25 + 0.75 * least(1.0, (l.affected - 1) / greatest(l.pages, 1)::DOUBLE) END), 6) AS points
FROM failed f JOIN lost l USING (bit) GROUP BY f.page_id""")
def a4(spark, sf_dir):
    """Points that one page's checks cost: the penalty of each of its checks less that with one page fewer."""
    masks = issues(spark, sf_dir)
    counts = C.affected(masks).crossJoin(F.broadcast(masks.agg(F.count("*").alias("pages"))))
    full = C.penalty(F.col("points"), F.col("affected"), F.col("pages"), F.col("scope") == "site_wide")
    less = F.when(F.col("affected") == 1, 0.0).otherwise(C.penalty(F.col("points"), F.col("affected") - 1, F.col("pages"), F.lit(False)))
    worth = counts.select("bit", (full - less).alias("worth"))  # one row per check
    rows = masks.select("page_id", F.explode(C.bits_of(F.col("issues"))).alias("bit"))
    return rows.join(F.broadcast(worth), "bit").groupBy("page_id").agg(F.round(F.sum("worth"), 6).alias("points"))


_CATEGORY = "CASE WHEN bit <= 5 THEN 'response' WHEN bit <= 11 THEN 'indexing' WHEN bit <= 23 THEN 'on_page' WHEN bit <= 26 THEN 'content' WHEN bit <= 32 THEN 'links' WHEN bit <= 37 THEN 'sitemap' ELSE 'technical' END"


@query("a15", FAILED + f"SELECT {_CATEGORY} AS category, count(DISTINCT page_id) AS failing FROM failed GROUP BY 1")
def a15(spark, sf_dir):
    """Failing pages per category of checks."""
    rows = issues(spark, sf_dir).select("page_id", F.explode(C.bits_of(F.col("issues"))).alias("bit"))
    return rows.select("page_id", F.expr(_CATEGORY).alias("category")).distinct().groupBy("category").agg(F.count("*").alias("failing"))


@query("a16", BASE + "SELECT to_id AS page_id, count(DISTINCT from_id) AS inlinks FROM edges WHERE from_id <> to_id GROUP BY 1")
def a16(spark, sf_dir):
    """Distinct pages that link to a page, itself left out."""
    pairs = edges(spark, sf_dir).where("from_id <> to_id").select("from_id", "to_id").distinct()
    return pairs.groupBy(F.col("to_id").alias("page_id")).agg(F.count("*").alias("inlinks"))


@query("a17", BASE + f"SELECT lower(trim(h1)) AS key, count(*) AS pages, min(page_id) AS first_page FROM cur WHERE {_OPEN} AND trim(h1) <> '' GROUP BY 1 HAVING count(*) > 1")
def a17(spark, sf_dir):
    """Groups of pages that share their first heading."""
    rows = current(spark, sf_dir).where(_OPEN).select("page_id", F.lower(F.trim("h1")).alias("key")).where("key <> ''")
    return rows.groupBy("key").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page")).where("pages > 1")


@query("a24", COUNTED + "SELECT CAST(sum(bit_count(x & ~y)) AS BIGINT) AS muted, CAST(sum(bit_count(y & ~x)) AS BIGINT) AS opened FROM (SELECT (m | 0)::BIGINT AS x, CASE WHEN page_id % 2 = 0 THEN m & ~(1::BIGINT << 40) ELSE m | (1::BIGINT << 8) END AS y FROM (SELECT page_id, sum(1::BIGINT << bit)::BIGINT AS m FROM failed GROUP BY 1))")
def a24(spark, sf_dir):
    """Checks that a policy would mute and open: set bits of either difference of the masks."""
    x = F.col("issues")
    y = F.when(F.col("page_id") % 2 == 0, x.bitwiseAND(F.lit(~(1 << 40)))).otherwise(x.bitwiseOR(F.lit(1 << 8)))
    rows = issues(spark, sf_dir).where("issues <> 0").select(x.alias("x"), y.alias("y"))
    return rows.agg(F.sum(F.expr("bit_count(x & ~y)")).cast("long").alias("muted"), F.sum(F.expr("bit_count(y & ~x)")).cast("long").alias("opened"))


@query("a25", BASE + f"SELECT count(*) FILTER ({_OK} AND {_T} > 50) AS title_over_50, count(*) FILTER ({_OPEN} AND word_count < 100) AS thin_100, count(*) FILTER (status <> 0 AND response_ms > 500) AS slow_500 FROM cur")
def a25(spark, sf_dir):
    """Pages flagged under other thresholds."""
    f = C.page_checks(C.Thresholds(title_long=50, thin_words=100, slow_ms=500))
    return current(spark, sf_dir).agg(F.count_if(f["title_too_long"]).alias("title_over_50"), F.count_if(f["thin_content"]).alias("thin_100"), F.count_if(f["slow_response"]).alias("slow_500"))


_REJUDGED = sum(1 << BITS[s] for s in ("title_too_long", "title_too_short", "description_too_long", "description_too_short", "thin_content", "slow_response", "redirect_chain", "images_missing_alt"))


@query("po6", FAILED + f"""
, kept AS (SELECT page_id, bit FROM failed WHERE (({_REJUDGED}::BIGINT >> bit) & 1) = 0),
again AS (SELECT page_id, 13 AS bit FROM cur WHERE {_OK} AND {_T} > 50 UNION ALL SELECT page_id, 14 FROM cur WHERE {_OK} AND {_T} BETWEEN 1 AND 19
 UNION ALL SELECT page_id, 18 FROM cur WHERE {PAGE_SQL['description_too_long']} UNION ALL SELECT page_id, 19 FROM cur WHERE {PAGE_SQL['description_too_short']}
 UNION ALL SELECT page_id, 24 FROM cur WHERE {_OPEN} AND word_count < 100 UNION ALL SELECT page_id, 40 FROM cur WHERE status <> 0 AND response_ms > 500
 UNION ALL SELECT page_id, 5 FROM cur WHERE hops > 2)
SELECT cur.page_id, CAST(coalesce(sum(1::BIGINT << bit), 0) AS BIGINT) AS issues FROM cur LEFT JOIN (SELECT * FROM kept UNION ALL SELECT * FROM again) USING (page_id) GROUP BY ALL""")
def po6(spark, sf_dir):
    """A stored crawl judged again: kept bits of the old mask, threshold bits under new limits."""
    pages = narrow(spark, sf_dir)
    t = C.Thresholds(title_long=50, title_short=20, thin_words=100, slow_ms=500, max_hops=2, check_images=False)
    again = {s: c for s, c in C.page_checks(t).items() if (_REJUDGED >> BITS[s]) & 1}
    old = C.issues(pages, edges(spark, sf_dir))
    new = pages.select("page_id", C.mask(again).alias("again"))
    return old.join(new, "page_id").select("page_id", F.col("issues").bitwiseAND(F.lit(~_REJUDGED)).bitwiseOR(F.col("again")).alias("issues"))


@query("j12", FAILED + "SELECT bit, page_id, url FROM (SELECT bit, page_id, url, row_number() OVER (PARTITION BY bit ORDER BY page_id) AS r FROM failed JOIN cur USING (page_id)) WHERE r <= 5")
def j12(spark, sf_dir):
    """The first five pages of each check (a top-k report; the group limit runs before the shuffle)."""
    rows = issues(spark, sf_dir).select("page_id", F.explode(C.bits_of(F.col("issues"))).alias("bit"))
    top = rows.withColumn("r", F.row_number().over(Window.partitionBy("bit").orderBy("page_id"))).where("r <= 5")
    return top.join(current(spark, sf_dir).select("page_id", "url"), "page_id").select("bit", "page_id", "url")


@query("t7", COUNTED + "SELECT slug, severity, affected, round(lost, 6) AS lost, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, lost DESC, slug) AS place FROM lost")
def t7(spark, sf_dir):
    """Fix list: by severity, then points. One row per check is sorted."""
    masks = issues(spark, sf_dir)
    rows = C.affected(masks).crossJoin(F.broadcast(masks.agg(F.count("*").alias("pages"))))
    rows = rows.withColumn("lost", C.penalty(F.col("points"), F.col("affected"), F.col("pages"), F.col("scope") == "site_wide"))
    rank = F.expr("CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END")
    return rows.select("slug", "severity", "affected", F.round("lost", 6).alias("lost"), F.row_number().over(Window.orderBy(rank, F.desc("lost"), "slug")).alias("place"))


@query("v9", COUNTED + "SELECT slug, round(lost * 0.6, 6) AS weighted FROM lost")
def v9(spark, sf_dir):
    """Points of the fix list as they weigh in the overall score."""
    masks = issues(spark, sf_dir)
    rows = C.affected(masks).crossJoin(F.broadcast(masks.agg(F.count("*").alias("pages"))))
    lost = C.penalty(F.col("points"), F.col("affected"), F.col("pages"), F.col("scope") == "site_wide")
    return rows.select("slug", F.round(lost * 0.6, 6).alias("weighted"))


@query("j24", FAILED + f"""
SELECT f.page_id, f.bit FROM failed f WHERE NOT EXISTS (SELECT 1 FROM prv WHERE prv.page_id = f.page_id)
UNION ALL SELECT f.page_id, f.bit FROM failed f JOIN prv USING (page_id) WHERE f.bit = 40 AND NOT (prv.status <> 0 AND prv.response_ms > 1000)
UNION ALL SELECT f.page_id, f.bit FROM failed f JOIN prv USING (page_id) WHERE f.bit = 0 AND prv.status NOT BETWEEN 400 AND 499""")
def j24(spark, sf_dir):
    """Page and check pairs that the baseline lacks: all of new pages; of known pages the gated checks (4xx, slow)."""
    from pagewright.plans.fixtures import previous

    gated = [BITS["http_4xx"], BITS["slow_response"]]
    now = issues(spark, sf_dir).select("page_id", F.explode(C.bits_of(F.col("issues"))).alias("bit"))
    old = previous(spark, sf_dir)
    new = now.join(old.select("page_id"), "page_id", "left_anti")
    flags = {s: c for s, c in C.page_checks().items() if BITS[s] in gated}
    before = old.select("page_id", F.explode(C.bits_of(C.mask(flags))).alias("bit"))
    known = now.where(F.col("bit").isin(gated)).join(old.select("page_id"), "page_id", "left_semi").join(before, ["page_id", "bit"], "left_anti")
    return new.unionByName(known)
