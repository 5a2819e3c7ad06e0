"""What a site's owner wants, judged on a crawl: preferred addresses, index rules, ignored parameters, pages that must work."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.dims import BITS
from pagewright.operators.access import first_rule
from pagewright.operators.explore import glob_regex
from pagewright.operators.graph import final_target


@dataclass(frozen=True)
class Policy:
    """slash: with, without or either. Index rules are (path glob, keep_out or index), the first that meets counts."""

    scheme: str = "https"
    host: str = ""
    slash: str = "either"
    index_rules: tuple[tuple[str, str], ...] = ()
    ignore_params: tuple[str, ...] = ()
    pagination_param: str = ""
    must_work: tuple[str, ...] = ()  # addresses


def off_address(url: Column, policy: Policy) -> Column:
    """scheme, host or slash: the first way in which an address is not in the preferred form; null if it is."""
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    file_like = F.regexp_like(path, F.lit(r"\.[^/]*$"))
    right = {"either": F.lit(True), "with": path.endswith("/") | file_like, "without": ~path.endswith("/")}[policy.slash]
    return (
        F.when(F.regexp_extract(url, "^([a-z]+)://", 1) != policy.scheme, "scheme")
        .when(F.lower(F.regexp_extract(url, "^[a-z]+://([^/?#:]*)", 1)) != policy.host, "host")
        .when((path != "/") & (path != "") & ~right, "slash")
    )


def ignored_params(url: Column, policy: Policy) -> Column:
    """The names of an address's parameters that the policy ignores, in order, each once."""
    names = F.transform(F.split(F.regexp_extract(url, r"[?]([^#]*)", 1), "&"), lambda p: F.split_part(p, F.lit("="), F.lit(1)))
    pattern = "(?i)^(" + "|".join(glob_regex(g)[1:].removesuffix("$") for g in policy.ignore_params) + ")$" if policy.ignore_params else "^$"
    return F.array_distinct(F.filter(names, lambda n: (n != "") & n.rlike(pattern) & (F.lower(n) != policy.pagination_param.lower())))


def _bit(slug: str) -> Column:
    return F.lit(1 << BITS[slug]).cast("long")


def address_pages(pages: DataFrame, edges: DataFrame, policy: Policy) -> DataFrame:
    """page_id of pages served, canonicalised or redirected to another form, and of those that link to such a redirect."""
    served = pages.where("html_ok").where(off_address(F.col("url"), policy).isNotNull() | off_address(F.col("canonical"), policy).isNotNull()).select("page_id")
    ends = final_target(pages).where(off_address(F.col("final_url"), policy).isNotNull())
    moved = pages.where("status BETWEEN 300 AND 399").select("page_id").join(ends, "page_id", "left_semi")
    target = pages.where("status BETWEEN 300 AND 399").where(off_address(F.col("url"), policy).isNotNull()).select(F.col("page_id").alias("to_id"))
    linked = edges.where("from_id <> to_id").join(target, "to_id", "left_semi").select(F.col("from_id").alias("page_id")).distinct()
    linked = pages.where("html_ok").select("page_id").join(linked, "page_id", "left_semi")
    return served.unionByName(moved).unionByName(linked).distinct()


def index_marks(pages: DataFrame, policy: Policy) -> DataFrame:
    """page_id, stance, slug: pages that an index rule covers, and the check that they fail, if any.

    Judged are html pages and those that robots.txt blocks. Kept-out pages fail if they are open to the index, and partly
    if robots.txt alone keeps them out; pages to be indexed fail if they are not.
    """
    subject = pages.where("html_ok OR indexability = 'blocked_by_robots'")
    ruled = first_rule(subject, list(policy.index_rules)).where("stance IS NOT NULL")
    slug = F.when((F.col("stance") == "keep_out") & (F.col("indexability") == "blocked_by_robots"), "policy_keep_out_partial").when(
        (F.col("stance") == "keep_out") == (F.col("indexability") == "indexable"), "policy_index_mismatch"
    )
    return ruled.select("page_id", "stance", slug.alias("slug"))


def param_pages(pages: DataFrame, policy: Policy) -> DataFrame:
    """page_id, param: html pages with an ignored parameter that are not canonicalised to an address without one."""
    rows = pages.where("html_ok").withColumn("params", ignored_params(F.col("url"), policy)).where(F.size("params") > 0)
    keeps = F.coalesce(F.size(ignored_params(F.col("canonical"), policy)) > 0, F.lit(False))
    rows = rows.where((F.col("indexability") == "indexable") | ((F.col("indexability") == "canonicalised") & keeps))
    return rows.select("page_id", F.element_at("params", 1).alias("param"))


def must_work_rows(pages: DataFrame, policy: Policy) -> DataFrame:
    """url, page_id, verdict: where each address that must work ends (page_id, null if the crawl did not reach it), and whether it works."""
    wanted = pages.sparkSession.createDataFrame([(u,) for u in policy.must_work], "url string")
    at = wanted.join(pages.select("url", F.col("page_id").alias("start")), "url", "left")
    moved = final_target(pages).select(F.col("page_id").alias("start"), "final_url")
    at = at.join(moved, "start", "left").withColumn("final_url", F.coalesce("final_url", "url"))
    end = pages.select(F.col("url").alias("final_url"), "page_id", "status", "indexability", "error")
    verdict = (
        F.when(F.col("page_id").isNull(), "not_checked")
        .when((F.col("status") == 0) & (F.col("indexability") == "blocked_by_robots"), "blocked by robots.txt")
        .when(F.col("status") == 0, F.coalesce("error", F.lit("could not be fetched")))
        .when(~F.col("status").between(200, 299), F.col("status").cast("string"))
        .when(F.col("indexability") == "indexable", "works")
        .otherwise(F.col("indexability"))
    )
    return at.join(end, "final_url", "left").select("url", "page_id", verdict.alias("verdict"))


def policy_issues(pages: DataFrame, edges: DataFrame, policy: Policy) -> DataFrame:
    """page_id, issues: the policy's bits of the pages that fail one."""
    parts = [
        address_pages(pages, edges, policy).select("page_id", _bit("policy_address").alias("issues")),
        index_marks(pages, policy).where("slug IS NOT NULL").select("page_id", F.when(F.col("slug") == "policy_index_mismatch", _bit("policy_index_mismatch")).otherwise(_bit("policy_keep_out_partial")).alias("issues")),
        param_pages(pages, policy).select("page_id", _bit("policy_param_canonical").alias("issues")),
        must_work_rows(pages, policy).where("page_id IS NOT NULL AND verdict <> 'works'").select("page_id", _bit("must_work_failed").alias("issues")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("page_id").agg(F.bit_or("issues").alias("issues"))


def with_policy(masks: DataFrame, marks: DataFrame) -> DataFrame:
    """masks (page_id, issues) with the policy's bits set."""
    marks = marks.withColumnRenamed("issues", "more")
    return masks.join(marks, "page_id", "left").select("page_id", F.col("issues").bitwiseOR(F.coalesce("more", F.lit(0).cast("long"))).alias("issues"))


def purpose_rules(bots: DataFrame, access: DataFrame, stances: DataFrame) -> DataFrame:
    """purpose, stance, now, bots, gaps: the bots of each purpose by what the owner wants and what they may do now.

    access: token, allowed (null where robots.txt gave no verdict), turned_away (a fetch as the bot was). A gap is a bot
    that is wanted and kept out, or unwanted and let in.
    """
    now = F.when(F.col("allowed").isNull(), "unknown").when(~F.col("allowed"), "blocked").when(F.col("turned_away"), "firewall").otherwise("allowed")
    rows = bots.join(stances, "token").join(access, "token", "left").withColumn("turned_away", F.coalesce("turned_away", F.lit(False))).withColumn("now", now)
    out = F.col("now").isin("blocked", "firewall")
    gap = ((F.col("stance") == "allow") & out) | ((F.col("stance") == "block") & (F.col("now") == "allowed"))
    return rows.groupBy("purpose", "stance", "now").agg(F.count("*").alias("bots"), F.count_if(gap).alias("gaps"))
