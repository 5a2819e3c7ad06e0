"""From answers of a crawl to the page table and the links that checks and scores read: html passes the parser once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.extract import extracted_beside
from pagewright.operators import graph as G
from pagewright.session import cut_lineage

#: Words of a robots meta that keep a page out, and content types that are pages.
_NOINDEX = r"(?i)(^|[,\s])(noindex|none)([,\s]|$)"
_HTML = r"(?i)text/html|application/xhtml\+xml"
_INDEXABILITY = (
    "CASE WHEN status = 0 AND error IS NULL THEN 'blocked_by_robots' WHEN status < 200 OR status >= 500 THEN 'server_error' WHEN status BETWEEN 300 AND 399 THEN 'redirected' "
    "WHEN status BETWEEN 400 AND 499 THEN 'client_error' WHEN has_noindex THEN 'noindex' WHEN canonical <> url THEN 'canonicalised' ELSE 'indexable' END"
)


def page_table(answers: DataFrame, root: int) -> tuple[DataFrame, DataFrame]:
    """Pages as checks read them, and links (from_id, to_id, edge_seq, nofollow, anchor) between pages that were crawled.

    answers: page_id, url, html, status, error, content_type, response_ms, hops, redirect_target, in_sitemap. Only answers that
    are html pages are parsed; the others have no fields. Of pages that share an address links lead to the least id. Depth is
    counted from root along links without nofollow; inlinks and outlinks count pages, a page itself left out. Rows without an id
    or an address take no part; a null html is an empty page.
    """
    is_page = F.col("status").between(200, 299) & (F.col("content_type").isNull() | F.col("content_type").rlike(_HTML))
    known = answers.where("page_id is not null and url is not null").withColumns({"status": F.coalesce("status", F.lit(0)), "html_ok": F.coalesce(is_page, F.lit(False))})
    rest = ("page_id", "url", "status", "error", "response_ms", "hops", "redirect_target", "in_sitemap", "html_ok")
    both = cut_lineage(extracted_beside(known, F.col("html_ok"), *rest))

    at = both.groupBy("url").agg(F.min("page_id").alias("to_id"))
    out = both.select(F.col("page_id").alias("from_id"), F.posexplode("fields.links").alias("place", "link"))
    # At most MOST_LINKS links of a page are read, so the place fits.
    links = out.select("from_id", "place", F.col("link.url").alias("url"), "link.nofollow", "link.anchor").join(at, "url")
    links = cut_lineage(links.select("from_id", "to_id", (F.col("from_id") * 10_000 + F.col("place")).alias("edge_seq"), "nofollow", "anchor"))
    pairs = links.where("from_id <> to_id").groupBy("from_id", "to_id").agg(F.bool_or("nofollow").alias("nofollow"))
    pairs = cut_lineage(pairs)
    outlinks = pairs.groupBy(F.col("from_id").alias("page_id")).agg(F.count("*").alias("outlinks_internal"), F.count_if("nofollow").alias("outlinks_nofollow"))
    inlinks = pairs.groupBy(F.col("to_id").alias("page_id")).agg(F.count("*").alias("inlinks"))
    rows = both.join(G.click_depth(links, root), "page_id", "left").join(outlinks, "page_id", "left").join(inlinks, "page_id", "left")

    f = lambda c: F.col(f"fields.{c}")
    no = lambda c: F.coalesce(c, F.lit(0))
    pages = rows.select(
        *rest, "depth", no(F.col("inlinks")).alias("inlinks"), no(F.col("outlinks_internal")).alias("outlinks_internal"), no(F.col("outlinks_nofollow")).alias("outlinks_nofollow"),
        f("title"), no(f("title_count")).alias("title_count"), f("description"), F.get(f("h1"), F.lit(0)).alias("h1"), F.coalesce(F.size(f("h1")), F.lit(0)).alias("h1_count"), no(f("word_count")).alias("word_count"),
        no(f("images_missing_alt")).alias("images_missing_alt"), no(f("mixed_content")).alias("mixed_content"), f("og_title"), f("og_image"), f("jsonld"), F.coalesce(F.size(f("hreflang")), F.lit(0)).alias("hreflang_size"),
        F.coalesce(F.exists(f("hreflang"), lambda h: h["url"] == F.col("url")), F.lit(False)).alias("hreflang_self"), f("canonical"), f("meta_robots"), F.coalesce(f("meta_robots").rlike(_NOINDEX), F.lit(False)).alias("has_noindex"),
        f("content_key"), f("mount").isNotNull().alias("mount"), F.coalesce(f("mount_empty"), F.lit(False)).alias("mount_empty"), F.coalesce(f("script_notice"), F.lit(False)).alias("script_notice"), (no(f("external_scripts")) > 0).alias("scripted"),
    ).withColumn("indexability", F.expr(_INDEXABILITY))
    return cut_lineage(pages), links
