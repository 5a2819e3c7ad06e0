"""Differences of two crawls of many sites, with moves of a site to another origin.

A snapshot is a row a site in crawls (site_id, origin, stop, robots_status, robots_print, sitemap_urls, sitemap_whole) and rows
in pages (site_id, url, status, error, indexability, title, canonical, hops, inlinks). Pages off their site's origin do not
count. Where the origin changed, the earlier addresses are put onto the new origin before pages are matched, so that a move is
one change. A crawl that stopped early says nothing about what it did not reach: no page is new against it, none removed by it.
An address that stands twice counts once, with its least row. A site that only one side knows gives no rows. Null statuses
count as 0, null titles as blank, null hops and inlinks as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.session import cut_lineage

#: Stops of a crawl, names of a page's state in messages, pages of a site that weigh more by their links.
WHOLE, BLOCKED = "completed", "robots_blocked"
STATE_NAMES = {
    "indexable": "Indexable", "noindex": "Noindex", "canonicalised": "Canonicalised", "blocked_by_robots": "BlockedByRobots",
    "redirected": "Redirected", "client_error": "ClientError", "server_error": "ServerError",
}
TOP_PAGES = 20
SEVERITIES = ("critical", "warning", "notice")

_PAGE = ("status", "error", "indexability", "title", "canonical", "hops", "inlinks")
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(\[[^\]]*\]|[^/?#:]*)(?::([0-9]*))?"


def origin_of(url: Column) -> Column:
    """scheme://host:port in small letters, the port written out; two addresses share it if they are of one origin."""
    scheme, host, port = (F.lower(F.regexp_extract(url, _URL, k)) for k in (1, 2, 3))
    usual = F.when(scheme == "https", "443").when(scheme == "http", "80").otherwise("")
    return F.concat(scheme, F.lit("://"), host, F.lit(":"), F.when(port == "", usual).otherwise(port))


def _on(url: Column, base: Column) -> Column:
    """url with its path and query on the origin that base names."""
    rest = F.regexp_replace(F.regexp_replace(url, _URL, ""), "#.*$", "")
    return F.concat(F.regexp_replace(base, "(?<![:/])/.*$", ""), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))


def home_origins(pages: DataFrame) -> DataFrame:
    """site_id, origin: where most pages of a site lie, for snapshots that do not name it; ties to the least name."""
    counts = pages.where("url is not null").groupBy("site_id", origin_of(F.col("url")).alias("at")).agg(F.count("*").alias("n"))
    best = counts.groupBy("site_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "at")).alias("m"))
    return best.select("site_id", F.concat(F.regexp_replace("m.at", "^(https://.*):443$|^(http://.*):80$", "$1$2"), F.lit("/")).alias("origin"))


def _failing(status: str, error: str) -> Column:
    """4xx, 5xx or no answer; without an answer and a reason a page is one that robots rules keep out."""
    return (F.col(status) >= 400) | ((F.col(status) == 0) & F.col(error).isNotNull())


def _side(pages: DataFrame, crawls: DataFrame, prefix: str, moves: bool) -> DataFrame:
    """site_id, at and the page's columns behind prefix: a row an address, those of the earlier crawl on the later origin."""
    plain = {"status": F.coalesce("status", F.lit(0)), "title": F.trim(F.coalesce("title", F.lit(""))), "hops": F.coalesce("hops", F.lit(0)), "inlinks": F.coalesce("inlinks", F.lit(0))}
    rows = pages.where("url is not null").select("site_id", "url", *(plain.get(c, F.col(c)).alias(c) for c in _PAGE)).join(crawls, "site_id")
    own = origin_of(F.col("q_origin" if moves else "p_origin"))
    rows = rows.where(origin_of(F.col("url")) == own)
    if moves:
        put = lambda c: F.when(F.col("moved") & (origin_of(F.col(c)) == own), _on(F.col(c), F.col("p_origin"))).otherwise(F.col(c))
        rows = rows.withColumns({"canonical": put("canonical"), "url": put("url")})
    page = F.min(F.struct(*_PAGE)).alias("page")
    return rows.groupBy("site_id", F.col("url").alias("at")).agg(page).select("site_id", "at", *(F.col(f"page.{c}").alias(f"{prefix}_{c}") for c in _PAGE))


def key_pages(pages: DataFrame, origins: DataFrame, starred: DataFrame, most: int = TOP_PAGES) -> DataFrame:
    """site_id, at: a site's start, its most linked pages (at, inlinks; ties by address) and the starred ones (site_id, url)."""
    place = F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("inlinks"), "at"))
    top = pages.withColumn("place", place).where(F.col("place") <= most).select("site_id", "at")
    rows = top.unionByName(origins.select("site_id", F.col("origin").alias("at"))).unionByName(starred.select("site_id", F.col("url").alias("at")))
    return rows.distinct()


def crawl_changes(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], starred: DataFrame) -> DataFrame:
    """site_id, kind, severity, url, before, after: what changed from one snapshot (crawls, pages) to the next.

    Changes of a page weigh one step more on key pages. One full join on site and address makes all changes of pages; its narrow
    rows are written once, as the counts of a site read them too.
    """
    known = ("origin", "stop", "robots_status", "robots_print", "sitemap_urls", "sitemap_whole")
    named = lambda df, s: df.select("site_id", *(F.col(c).alias(f"{s}_{c}") for c in known))
    sites = named(after[0], "p").join(named(before[0], "q"), "site_id")
    sites = cut_lineage(sites.withColumn("moved", origin_of(F.col("p_origin")) != origin_of(F.col("q_origin"))))
    of = sites.select("site_id", "moved", "p_origin", "q_origin", (F.col("p_stop") == WHOLE).alias("p_whole"), (F.col("q_stop") == WHOLE).alias("q_whole"))
    origins = of.select("site_id", "moved", "p_origin", "q_origin")
    now, then = _side(after[1], origins, "p", False), _side(before[1], origins, "q", True)
    now, then = now.withColumn("now", F.lit(True)), then.withColumn("then", F.lit(True))
    both = cut_lineage(now.join(then, ["site_id", "at"], "full"))
    keys = key_pages(both.where("now").select("site_id", "at", F.col("p_inlinks").alias("inlinks")), of.select("site_id", F.col("p_origin").alias("origin")), starred)
    rows = both.join(of, "site_id").join(keys.withColumn("key", F.lit(1)), ["site_id", "at"], "left")

    text = lambda c: F.col(c).cast("string")
    state = F.create_map(*(F.lit(x) for pair in STATE_NAMES.items() for x in pair))
    matched, anew = F.col("now") & F.col("then"), _failing("p_status", "p_error") & ~_failing("q_status", "q_error")
    none = lambda c: F.coalesce(c, F.lit("none"))
    # kind, when, rank of its severity, before, after
    made = [
        ("new_url", F.col("then").isNull() & F.col("q_whole"), F.lit(2), F.lit(""), text("p_status")),
        ("removed_url", F.col("now").isNull() & F.col("p_whole"), F.lit(2), text("q_status"), F.lit("")),
        ("status_changed", matched & (F.col("p_status") != F.col("q_status")), F.when(anew, 1).otherwise(2), text("q_status"), text("p_status")),
        ("became_noindex", matched & (F.col("p_indexability") == "noindex") & ~F.col("q_indexability").eqNullSafe(F.lit("noindex")), F.lit(1), state[F.col("q_indexability")], state[F.col("p_indexability")]),
        ("title_changed", matched & (F.col("q_title") != "") & (F.col("p_title") != "") & (F.col("p_title") != F.col("q_title")), F.lit(2), F.col("q_title"), F.col("p_title")),
        ("title_removed", matched & (F.col("q_title") != "") & (F.col("p_title") == ""), F.lit(1), F.col("q_title"), F.lit("")),
        ("canonical_changed", matched & ~F.col("p_canonical").eqNullSafe(F.col("q_canonical")), F.lit(2), none(F.col("q_canonical")), none(F.col("p_canonical"))),
        ("redirect_chain_grew", matched & (F.col("p_hops") > F.col("q_hops")), F.lit(2), text("q_hops"), text("p_hops")),
    ]
    up = F.when(F.col("key").isNotNull(), 1).otherwise(0)
    found = F.array(*(F.when(when, F.struct(F.lit(k).alias("kind"), F.greatest(F.lit(0), rank - up).alias("rank"), b.alias("before"), a.alias("after"))) for k, when, rank, b, a in made))
    severity = lambda r: F.element_at(F.array(*map(F.lit, SEVERITIES)), r + 1)
    of_pages = rows.select("site_id", F.col("at").alias("url"), F.explode(F.filter(found, lambda c: c.isNotNull())).alias("c"))
    of_pages = of_pages.select("site_id", "c.kind", severity(F.col("c.rank")).alias("severity"), "url", "c.before", "c.after")

    anew_or_new = F.when(F.col("then").isNull(), F.col("q_whole") & _failing("p_status", "p_error")).otherwise(anew)
    counts = both.join(of.select("site_id", "q_whole"), "site_id").groupBy("site_id").agg(
        F.count("now").alias("pages"), F.count_if(F.col("now") & anew_or_new).alias("anew"),
        F.count_if(F.col("then") & _failing("q_status", "q_error")).alias("were"), F.count_if(F.col("now") & _failing("p_status", "p_error")).alias("are"),
    )
    return of_pages.unionByName(_of_sites(sites, counts))


def _of_sites(sites: DataFrame, counts: DataFrame) -> DataFrame:
    """Changes of whole sites: a move, an error spike, the robots file, the sitemap."""
    c = F.col
    status = lambda s: F.coalesce(c(f"{s}_robots_status").cast("string"), F.lit("none"))
    blocked = (c("p_stop") == BLOCKED) & (c("q_stop") != BLOCKED)
    both_there = c("p_robots_status").isNotNull() & c("q_robots_status").isNotNull()
    rules = both_there & (c("p_robots_status") == c("q_robots_status")) & ~c("p_robots_print").eqNullSafe(c("q_robots_print"))
    notes = F.concat_ws(", ", F.when(rules, "rules changed"), F.when(blocked, "blocks the crawl"))
    shrank = c("p_sitemap_whole") & c("q_sitemap_whole") & (c("q_sitemap_urls") > 0) & (c("p_sitemap_urls") * 10 <= c("q_sitemap_urls") * 9)
    bound = F.greatest(F.lit(3), F.ceil(c("pages") * 2 / 100))
    made = [
        ("site_moved", c("moved"), F.lit("critical"), c("q_origin"), c("p_origin")),
        ("error_spike", c("anew") >= bound, F.lit("critical"), c("were").cast("string"), c("are").cast("string")),
        ("robots_txt_changed", (status("p") != status("q")) | rules | blocked, F.when(blocked, "critical").otherwise("warning"), status("q"), F.when(notes != "", F.concat(status("p"), F.lit(" ("), notes, F.lit(")"))).otherwise(status("p"))),
        ("sitemap_shrank", shrank, F.lit("warning"), c("q_sitemap_urls").cast("string"), c("p_sitemap_urls").cast("string")),
    ]
    one = lambda k, when, s, b, a: F.when(when, F.struct(F.lit(k).alias("kind"), s.alias("severity"), F.lit(None).cast("string").alias("url"), b.alias("before"), a.alias("after")))
    found = F.filter(F.array(*(one(*m) for m in made)), lambda x: x.isNotNull())
    return sites.join(counts, "site_id", "left").select("site_id", F.inline(found))
