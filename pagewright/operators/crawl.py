"""The order in which a crawler with a page budget takes in a site, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.session import cut_lineage

FOUND_DDL = "page_id long, depth int, parent_id long, found_by string"
#: In a sorted table, monotonically_increasing_id counts a partition's rows in its low bits.
_ROW_BITS = 33


def first_places(level: DataFrame, most: int) -> DataFrame:
    """The first most rows of level by place, where place is the id that its sorted partitions were written with."""
    part = F.shiftright("place", _ROW_BITS)
    sizes = sorted((r.part, r.n) for r in level.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row a task
    keep, before = F.lit(False), 0
    for k, n in sizes:
        if before + n >= most:
            keep = (part < k) | ((part == k) & (F.col("place") - F.lit(k << _ROW_BITS) < most - before))
            break
        before += n
    else:
        return level
    return level.where(keep)


def crawl_order(pages: DataFrame, edges: DataFrame, root: int, budget: int, passes: int = 4) -> DataFrame:
    """page_id, depth, parent_id, found_by ('start', 'link', 'redirect', 'sitemap') of the pages that a crawl takes in.

    pages: page_id, follow (false: its links are not followed), redirect_to (a page or null), in_sitemap. edges: from_id,
    to_id, edge_seq, nofollow. The crawl goes level by level. Pages of a level stand in the order in which they were
    found: by the place of the page that links them, then by edge_seq, so the first link to a page gives its parent. Links
    that say nofollow, links of pages that say so or that redirect, and links to unknown pages are not followed.

    The target of a redirect that no earlier level has seen is taken in with its redirect, at its depth and under its parent,
    before the links of that level count; its own links follow those of its redirect's place. Chains are followed
    passes times. Targets cost no budget, as their answer has come with the redirect. When the budget is used up, the rest of the
    level is left out. What is left of it after the last level goes to pages of the sitemap that nothing has found, by id;
    they have no depth and their links are not followed.

    The budget is the number of pages that a crawl may take in; none (0), or an unknown root, gives no rows. Null ids take no part.
    """
    spark = pages.sparkSession
    known = pages.where("page_id is not null").select("page_id", "follow", "redirect_to", "in_sitemap").dropDuplicates(["page_id"])
    known = cut_lineage(known)
    empty = spark.createDataFrame([], FOUND_DDL)
    if budget < 1 or known.where(F.col("page_id") == root).isEmpty():
        return empty
    redirects = known.where("redirect_to is not null").select("page_id", F.col("redirect_to").alias("target"))
    redirects = redirects.join(known.select(F.col("page_id").alias("target")), "target", "left_semi").select("page_id", "target")
    any_redirect = not redirects.isEmpty()
    sources = known.where("follow and redirect_to is null").select(F.col("page_id").alias("from_id"))
    links = edges.where("not nofollow").groupBy("from_id", "to_id").agg(F.min("edge_seq").alias("edge_seq"))
    links = links.join(sources, "from_id", "left_semi").join(known.select(F.col("page_id").alias("to_id")), "to_id", "left_semi")
    links = cut_lineage(links.select("from_id", "to_id", "edge_seq"))

    level = spark.createDataFrame([(root, 0, None, "start", 0)], f"{FOUND_DDL}, place long")
    seen, admitted, depth = level.drop("place"), 1, 0
    while True:
        heads, going = level.select("page_id", "parent_id", "place", F.lit(0).alias("hop")), level
        for hop in range(1, passes + 1) if any_redirect else ():
            targets = going.join(redirects, "page_id").groupBy("target").agg(F.min(F.struct("place", "page_id", "parent_id")).alias("by"))
            targets = targets.select(F.col("target").alias("page_id"), F.lit(depth).alias("depth"), "by.parent_id", F.lit("redirect").alias("found_by"), "by.place")
            going = cut_lineage(targets.join(seen, "page_id", "left_anti"))
            if going.isEmpty():
                break
            seen = seen.unionByName(going.drop("place"))
            heads = heads.unionByName(going.select("page_id", "parent_id", "place", F.lit(hop).alias("hop")))
        if admitted >= budget:
            break
        by = F.min(F.struct("place", "hop", "edge_seq", F.col("page_id").alias("parent_id"))).alias("by")
        found = heads.join(links, F.col("page_id") == F.col("from_id")).groupBy("to_id").agg(by).withColumnRenamed("to_id", "page_id")
        found = found.join(seen, "page_id", "left_anti").orderBy("by", "page_id")
        depth += 1
        level = found.select("page_id", F.lit(depth).alias("depth"), "by.parent_id", F.lit("link").alias("found_by"), F.monotonically_increasing_id().alias("place"))
        level = cut_lineage(level)
        size = level.count()
        if not size:
            break
        if size > budget - admitted:
            level, size = first_places(level, budget - admitted), budget - admitted
        admitted += size
        seen = seen.unionByName(level.drop("place"))
        if depth % 8 == 0:
            seen = cut_lineage(seen)
    if admitted < budget:
        rest = known.where("in_sitemap").select("page_id").join(seen, "page_id", "left_anti").orderBy("page_id")
        rest = cut_lineage(rest.select("page_id", F.monotonically_increasing_id().alias("place")))
        rest = first_places(rest, budget - admitted).select("page_id", F.lit(None).cast("int").alias("depth"), F.lit(None).cast("long").alias("parent_id"), F.lit("sitemap").alias("found_by"))
        seen = seen.unionByName(rest)
    return seen
