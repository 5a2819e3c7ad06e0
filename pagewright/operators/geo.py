"""How a site stands with AI crawlers and answer engines: llms.txt, declared preferences, findings, product verdicts, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.dims import SEVERITY_RANK

NOTICE_BYTES = 100 * 1024
LEAST_CHARS = 50
_TEXT_TYPES = ("text/plain", "text/markdown", "text/x-markdown")


def mime(content_type: Column) -> Column:
    return F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))


def llms_state(status: Column, error: Column, content_type: Column, body: Column) -> Column:
    """available, absent, soft_not_found or unavailable: what a fetch of llms.txt came to."""
    body = F.ltrim(F.regexp_replace(F.coalesce(body, F.lit("")), r"^\x{FEFF}", ""))
    page = body.rlike(r"(?i)^\s*(<!doctype html|<html|<head|<body)")
    no_heading = mime(content_type).isin("text/html", "application/xhtml+xml") & ~body.rlike(r"(?m)^\s*#{1,6}\s+\S")
    return (
        F.when(error.isNotNull(), "unavailable")
        .when(status == 429, "unavailable")
        .when(status.between(400, 499), "absent")
        .when(status.between(200, 299) & (page | no_heading), "soft_not_found")
        .when(status.between(200, 299), "available")
        .otherwise("unavailable")
    )


def with_adoption(reports: DataFrame, site: str, order: str) -> DataFrame:
    """reports (with llms_state) and adopted: a file means yes, its removal no, a failure what the report before said."""
    decisive = F.when(F.col("llms_state") == "available", True).when(F.col("llms_state") != "unavailable", False)
    past = Window.partitionBy(site).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return reports.withColumn("adopted", F.coalesce(F.last(decisive, ignorenulls=True).over(past), F.lit(False)))


def has_verdicts() -> Column:
    return F.col("robots").isin("read", "missing")


def advice(reports: DataFrame) -> DataFrame:
    """report, kind, severity: findings on llms.txt, content signals and Markdown, all of them advice."""
    one = lambda kind, severity, holds: F.when(holds, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity")))
    found = F.array_compact(F.array(
        one("llms_txt_unavailable", "warning", (F.col("llms_state") == "unavailable") & F.col("adopted")),
        one("content_signals_missing", "notice", has_verdicts() & (F.col("valid_signals") == 0)),
        one("markdown_unavailable", "notice", F.col("home_read") & (F.col("markdown") == "not_served")),
    ))
    return reports.select("report", F.inline(found))


def evaluated_kinds() -> Column:
    """The kinds of findings that a report may judge; an open incident of another kind is not resolved by it."""
    kinds = {
        "robots_unavailable": F.col("robots") != "unknown",
        "bots_blocked": has_verdicts() & (F.col("important") > 0),
        "bots_not_blocked": has_verdicts() & (F.col("important") > 0),
        "answers_restricted": F.col("html_important") > 0,
        "fetch_blocked": F.coalesce(F.col("probes_conclusive"), F.lit(False)),
        "content_missing": F.col("has_content") & has_verdicts(),
        "llms_txt_unavailable": F.col("llms_state").isNotNull(),
        "content_signals_missing": has_verdicts(),
        "markdown_unavailable": F.col("home_read") & F.coalesce(F.col("markdown") != "unreachable", F.lit(False)),
    }
    return F.array_compact(F.array(*(F.when(holds, F.lit(kind)) for kind, holds in kinds.items())))


def llms_checks(files: DataFrame) -> DataFrame:
    """file, check, passed of files (file, doc as of llms_sections, text, content_type, bytes, truncated, checked, failing)."""
    linked = F.filter("doc.sections", lambda s: F.size(s["links"]) > 0)
    checks = {
        "h1": F.col("doc.title").isNotNull() & F.col("doc.h1_first"),
        "summary": F.col("doc.summary").isNotNull(),
        "sections": F.size(linked) > 0,
        "links": F.size(F.flatten("doc.sections.links")) > 0,
        "length": F.char_length("text") >= LEAST_CHARS,
        "size": ~F.col("truncated") & (F.col("bytes") <= NOTICE_BYTES),
        "mime": mime(F.col("content_type")).isin(*_TEXT_TYPES),
        "links_resolve": F.col("failing") == 0,
    }
    rows = F.array(*(F.struct(F.lit(c).alias("check"), F.coalesce(holds, F.lit(False)).alias("passed")) for c, holds in checks.items()))
    return files.select("file", F.inline(rows))


def preference_changes(reports: DataFrame, site: str, order: str) -> DataFrame:
    """site, report, key, before, after: declared preferences (map declared) that differ from those of the report before."""
    earlier = reports.withColumn("was", F.lag("declared").over(Window.partitionBy(site).orderBy(order))).where("was IS NOT NULL")
    key = F.explode(F.array_union(F.map_keys("declared"), F.map_keys("was")))
    rows = earlier.select(site, "report", "declared", "was", key.alias("key"))
    rows = rows.select(site, "report", "key", F.try_element_at("was", "key").alias("before"), F.try_element_at("declared", "key").alias("after"))
    return rows.where(~F.col("before").eqNullSafe(F.col("after")))


def product_reach() -> Column:
    """reachable, allowed, limited, blocked or unknown, of a product by robots.txt, fetches and markup, the first that holds.

    Columns: robots, home_allowed, blocked_pages, fetched (hard, soft, same, not_run, skipped), limited_pages, fetcher_gets_in.
    """
    kept_out = ~F.col("home_allowed") | (F.col("fetched") == "hard")
    return (
        F.when(F.col("robots") == "unavailable", "blocked")
        .when(~has_verdicts(), "unknown")
        .when(kept_out & F.col("fetcher_gets_in"), "limited")
        .when(kept_out, "blocked")
        .when((F.col("blocked_pages") > 0) | (F.col("fetched") == "soft") | (F.col("limited_pages") > 0), "limited")
        .when(F.col("fetched") == "same", "reachable")
        .otherwise("allowed")
    )


def product_fit() -> Column:
    """wanted, per_policy, policy_says_block or no_preference: how the reach sits with the owner's stance."""
    kept_out = F.when(has_verdicts(), ~F.col("home_allowed") | (F.col("fetched") == "hard")).otherwise(F.col("robots") == "unavailable")
    return (
        F.when(F.col("stance") == "any", "no_preference")
        .when((F.col("stance") == "block") & kept_out, "per_policy")
        .when((F.col("stance") == "block") & has_verdicts(), "policy_says_block")
        .otherwise("wanted")
    )


def bot_status() -> Column:
    """What a bot may do against what the owner wants. Columns: stance, allowed, blocked_pages, problem (hard, soft or null), honours."""
    allow, block, allowed = F.col("stance") == "allow", F.col("stance") == "block", F.col("allowed")
    return (
        F.when(allowed.isNull(), "—")
        .when(allow & ~allowed, "Blocked")
        .when(allow & (F.col("blocked_pages") > 0), "Partly blocked")
        .when(allow & (F.col("problem") == "hard"), "Firewall blocks")
        .when(allow & (F.col("problem") == "soft"), "Treated differently")
        .when(allow, "OK")
        .when(block & ~allowed, "Blocked, as wanted")
        .when(block, "Not blocked")
        .when(~allowed, "Blocked")
        .otherwise("Allowed (no preference)")
    )


def needs_attention() -> Column:
    """Bots that the list of what needs attention keeps: unwanted blocks, and unwanted entry of bots that honour robots.txt."""
    s = F.col("status")
    wanted = (F.col("stance") == "allow") & s.isin("Blocked", "Partly blocked", "Firewall blocks", "Treated differently")
    return wanted | ((F.col("stance") == "block") & (s == "Not blocked") & F.col("honours"))


def bots_list(bots: DataFrame, group: str, search: str = "", attention_only: bool = False, selected: str = "") -> DataFrame:
    """group, token, status, attention, chosen: the bots that a search finds, and which is shown (the first where the asked one is not there)."""
    rows = bots.withColumn("status", bot_status()).withColumn("attention", needs_attention())
    rows = rows.where(F.contains(F.lower("token"), F.lit(search.lower())) & (F.col("attention") | F.lit(not attention_only)))
    first = rows.agg(F.coalesce(F.max(F.when(F.col("token") == selected, F.col("token"))), F.min_by("token", F.struct(group, "token"))).alias("shown"))
    return rows.crossJoin(F.broadcast(first)).select(F.col(group).alias("group"), "token", "status", "attention", (F.col("token") == F.col("shown")).alias("chosen"))


def gate(counts: DataFrame, findings: DataFrame, gaps: DataFrame, seen: DataFrame, thresholds: list[str]) -> DataFrame:
    """rule, severity, n: what trips a gate. The most lenient threshold decides for checks.

    counts: slug, severity, affected; findings and gaps: kind or rule, subject, severity; seen: rule, subject of the
    baseline, whose findings and gaps do not count again.
    """
    most = max(SEVERITY_RANK[t] for t in thresholds)
    rank = F.expr("CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END")
    checks = counts.where(rank <= most).select(F.col("slug").alias("rule"), "severity", F.col("affected").alias("n"))
    others = findings.select(F.concat(F.lit("finding:"), "kind").alias("rule"), "subject", "severity").unionByName(gaps.select(F.concat(F.lit("policy:"), "rule").alias("rule"), "subject", "severity"))
    new = others.where(rank <= most).join(seen, ["rule", "subject"], "left_anti").groupBy("rule", "severity").agg(F.count("*").alias("n"))
    return checks.unionByName(new)


def incident_writes(transitions: DataFrame, held: DataFrame, quiet_kinds: list[str], advisory: list[str], keys: list[str]) -> DataFrame:
    """keys, step, change, quiet, accepted, snooze_escalated: what transitions write.

    transitions: keys, kind, step (opened, updated, resolved), escalated, widened; held: keys, accepted, snoozed,
    escalation_due, quiet of the open incidents. change is written, muted (the owner sleeps on it: written as already
    told), or null where nothing is. Kinds that no earlier report judged, and advice, open quietly; an accepted incident
    writes nothing until it escalates, which takes the acceptance back; one that is due after a snooze is announced.
    """
    no = F.lit(False)
    rows = transitions.join(held, keys, "left")
    accepted, snoozed, due, quiet = (F.coalesce(c, no) for c in ("accepted", "snoozed", "escalation_due", "quiet"))
    opened, updated = F.col("step") == "opened", F.col("step") == "updated"
    counts = ~F.col("kind").isin(*advisory)
    unaccept = updated & counts & F.col("escalated") & accepted
    announce = unaccept | (updated & counts & due) | (updated & counts & (F.col("escalated") | F.col("widened")) & ~accepted)
    silent = F.col("kind").isin(*quiet_kinds, *advisory)
    change = (
        F.when(opened & ~silent, "written")
        .when(announce & snoozed, "muted")
        .when(unaccept, "written")
        .when((announce | ((F.col("step") == "resolved") & ~quiet)) & ~accepted, F.when(snoozed, "muted").otherwise("written"))
    )
    return rows.select(
        *keys, "step", change.alias("change"), F.when(opened, silent).otherwise(quiet & ~announce).alias("quiet"), (accepted & ~unaccept).alias("accepted"),
        F.when(announce & snoozed & F.col("escalated"), True).when(announce & ~snoozed, False).alias("snooze_escalated"),
    )


def recheck_verdicts(planned: DataFrame, fresh: DataFrame, keys: list[str], item: str) -> DataFrame:
    """keys, verdict, pages, seen: what a recheck of incidents came to.

    planned: keys and item (a page of the incident's evidence), fails as stored; fresh: keys, item, fails, conclusive. A fresh
    answer stands in for the stored one. Pages that did not answer conclusively leave the incident open, unless one fails.
    """
    now = planned.join(fresh.select(*keys, item, F.col("fails").alias("now_fails"), "conclusive"), [*keys, item], "left")
    sure = F.coalesce(F.col("conclusive"), F.lit(False))
    by = now.groupBy(*keys).agg(F.count("*").alias("pages"), F.count_if(sure).alias("seen"), F.count_if(sure & F.col("now_fails")).alias("failing"))
    verdict = F.when(F.col("failing") > 0, "still_failing").when(F.col("seen") < F.col("pages"), "inconclusive").otherwise("clean")
    return by.select(*keys, verdict.alias("verdict"), "pages", "seen")


def best_section(pages: DataFrame, links: DataFrame) -> DataFrame:
    """page_id, section, shared: the section whose links share most leading path segments with a page (ties to the first
    section by name); pages (page_id, path) without any are left out. Prefixes meet by an equal join, no pairs are formed."""
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(segments, F.lit(1), n), "/").alias("prefix")))
    held = F.when(F.size(segments) > 0, prefixes)
    sections = links.select("section", F.inline(held)).groupBy("n", "prefix").agg(F.min("section").alias("section"))
    met = pages.select("page_id", F.inline(held)).join(sections, ["n", "prefix"])
    return met.groupBy("page_id").agg(F.max_by("section", "n").alias("section"), F.max("n").alias("shared"))
