"""The audit's checks as columns, their mask, and the scores made of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.dims import BITS, checks_dim


@dataclass(frozen=True)
class Thresholds:
    """Limits that a site's owner may change."""

    title_long: int = 60
    title_short: int = 30
    description_long: int = 160
    description_short: int = 70
    thin_words: int = 200
    slow_ms: int = 1000
    max_hops: int = 1
    check_images: bool = True


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit("")) == ""


def trimmed_length(c: Column) -> Column:
    return F.char_length(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", ""))


def page_checks(t: Thresholds = Thresholds()) -> dict[str, Column]:
    """Checks that one page's columns decide."""
    c = F.col
    ok, indexable = c("html_ok"), c("html_ok") & (c("indexability") == "indexable")
    title, description = trimmed_length(c("title")), trimmed_length(c("description"))
    success = c("status").between(200, 299)
    return {
        "http_4xx": c("status").between(400, 499),
        "http_5xx": c("status").between(500, 599),
        "fetch_failed": c("error").isNotNull() & ~c("error").isin("redirect_loop", "too_many_redirects"),
        "redirect_loop": c("error").isin("redirect_loop", "too_many_redirects"),
        "redirected": c("status").between(300, 399) & c("error").isNull(),
        "redirect_chain": c("hops") > t.max_hops,
        "noindex": c("indexability") == "noindex",
        "canonicalised": c("indexability") == "canonicalised",
        "canonical_missing": indexable & c("canonical").isNull(),
        "blocked_by_robots": c("indexability") == "blocked_by_robots",
        "title_missing": ok & blank(c("title")),
        "title_too_long": ok & (title > t.title_long),
        "title_too_short": ok & (title >= 1) & (title < t.title_short),
        "title_multiple": ok & (c("title_count") > 1),
        "description_missing": ok & blank(c("description")),
        "description_too_long": ok & (description > t.description_long),
        "description_too_short": ok & (description >= 1) & (description < t.description_short),
        "h1_missing": ok & ((c("h1_count") == 0) | blank(c("h1"))),
        "h1_multiple": ok & (c("h1_count") > 1),
        "thin_content": indexable & (c("word_count") < t.thin_words),
        "images_missing_alt": ok & (c("images_missing_alt") >= 1) & F.lit(t.check_images),
        "no_internal_outlinks": ok & (c("outlinks_internal") == 0),
        "nofollow_internal_links": ok & (c("outlinks_nofollow") > 0),
        "deep_page": success & (c("depth") > 3),
        "mixed_content": c("url").startswith("https://") & (c("mixed_content") > 0),
        "not_https": c("url").startswith("http://") & success,
        "slow_response": (c("status") != 0) & (c("response_ms") > t.slow_ms),
        "og_missing": indexable & (blank(c("og_title")) | blank(c("og_image"))),
        "jsonld_invalid": ok & (c("jsonld") == "invalid"),
        "hreflang_missing_self": ok & (c("hreflang_size") > 0) & ~c("hreflang_self"),
    }


def sitemap_checks() -> dict[str, Column]:
    c = F.col
    listed = c("in_sitemap")
    return {
        "orphan": listed & c("depth").isNull() & (c("inlinks") == 0),
        "sitemap_non_200": listed & ~c("status").between(200, 299),
        "sitemap_noindex": listed & (c("indexability") == "noindex"),
        "sitemap_canonicalised": listed & (c("indexability") == "canonicalised"),
        "not_in_sitemap": ~listed & (c("indexability") == "indexable"),
    }


def mask(flags: dict[str, Column]) -> Column:
    """One long with a bit for each check that holds; an unknown answer counts as no."""
    total = F.lit(0).cast("long")
    for slug, holds in flags.items():
        total = total.bitwiseOR(F.when(F.coalesce(holds, F.lit(False)), F.lit(1 << BITS[slug])).otherwise(F.lit(0)).cast("long"))
    return total


def duplicates(pages: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """page_id, issues: html pages open to the index that share a non-blank key (by slug of its check) with another one.

    All kinds of keys are counted in one aggregate (partial counts before the shuffle), so that a key that very many
    pages share does not have to meet whole in one task.
    """
    made = F.array(*(F.struct(F.lit(BITS[slug]).alias("bit"), key.alias("key")) for slug, key in keys.items()))
    open_ = pages.where(F.col("html_ok") & (F.col("indexability") == "indexable")).select("page_id", F.explode(made).alias("k")).select("page_id", "k.bit", "k.key").where("key <> ''")
    shared = open_.groupBy("bit", "key").count().where("count > 1").select("bit", "key")
    return open_.join(shared, ["bit", "key"]).select("page_id", F.expr("shiftleft(CAST(1 AS BIGINT), bit)").alias("issues"))


def site_checks(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """page_id, issues: the checks that need other pages or the links."""
    folded = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    shared = duplicates(pages, {"title_duplicate": folded("title"), "description_duplicate": folded("description"), "h1_duplicate": folded("h1"), "content_duplicate": F.col("content_key")})
    target = pages.select(F.col("url").alias("canonical"), F.col("status").alias("target_status"))
    lost = pages.where("canonical <> url").select("page_id", "canonical").join(target, "canonical").where(~F.col("target_status").between(200, 299))
    lost = lost.select("page_id", F.lit(1 << BITS["canonical_to_non_200"]).cast("long").alias("issues"))
    kind = F.when((F.col("status") >= 400) | F.col("error").isNotNull(), BITS["links_to_broken"]).when(F.col("status").between(300, 399), BITS["links_to_redirect"])
    bad = pages.select(F.col("page_id").alias("to_id"), kind.alias("bit")).where("bit is not null")
    # A page's bits are combined before the shuffle; links from pages that were not crawled fall to the join in issues().
    linked = edges.select("from_id", "to_id").join(bad, "to_id").select(F.col("from_id").alias("page_id"), F.expr("shiftleft(CAST(1 AS BIGINT), bit)").alias("issues"))
    return shared.unionByName(lost).unionByName(linked).groupBy("page_id").agg(F.bit_or("issues").alias("issues")).join(pages.select("page_id"), "page_id", "left_semi")


def issues(pages: DataFrame, edges: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """page_id, issues of every page: page, sitemap and site checks in one mask."""
    own = pages.select("page_id", mask(page_checks(t) | sitemap_checks()).alias("own"))
    site = site_checks(pages, edges)
    return own.join(site, "page_id", "left").select("page_id", F.col("own").bitwiseOR(F.coalesce("issues", F.lit(0).cast("long"))).alias("issues"))


def bits_of(issues_: Column) -> Column:
    """The numbers of the bits that are set."""
    return F.filter(F.sequence(F.lit(0), F.lit(len(BITS) - 1)), lambda b: F.getbit(issues_, b) == 1)


def affected(masks: DataFrame) -> DataFrame:
    """bit, slug, severity, scope, points, affected of each check that some page fails."""
    counts = masks.select(F.explode(bits_of(F.col("issues"))).alias("bit")).groupBy("bit").agg(F.count("*").alias("affected"))
    return counts.join(F.broadcast(checks_dim(masks.sparkSession)), "bit")


def penalty(points: Column, n: Column, pages: Column, site_wide: Column) -> Column:
    """Points that a check costs: a quarter at once, the rest by the share of pages."""
    share = F.when(site_wide, 1.0).otherwise(F.least(F.lit(1.0), n / F.greatest(pages, F.lit(1))))
    return points * (0.25 + 0.75 * share)


def score(lost: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), 100 - F.coalesce(lost, F.lit(0.0)))).cast("int")


def health_score(counts: DataFrame, n_pages: DataFrame) -> DataFrame:
    """health_score from affected() and a one-row frame (pages)."""
    lost = counts.crossJoin(F.broadcast(n_pages)).select(penalty(F.col("points"), F.col("affected"), F.col("pages"), F.col("scope") == "site_wide").alias("lost"))
    return lost.agg(score(F.sum("lost")).alias("health_score"))


def gains(counts: DataFrame, n_pages: DataFrame) -> DataFrame:
    """slug, affected, gain: points that the score regains if one check were clean. One row per check is sorted."""
    rows = counts.crossJoin(F.broadcast(n_pages))
    rows = rows.withColumn("lost", penalty(F.col("points"), F.col("affected"), F.col("pages"), F.col("scope") == "site_wide"))
    total = F.sum("lost").over(Window.partitionBy())
    clamp = lambda c: F.greatest(F.lit(0.0), 100 - c)
    return rows.withColumn("total", total).select("slug", "affected", F.round(clamp(F.col("total") - F.col("lost")) - clamp(F.col("total")), 6).alias("gain"))
