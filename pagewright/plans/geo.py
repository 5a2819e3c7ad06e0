"""Reports on AI access, one for each crawl, and what follows from them: findings, verdicts per product, bots, gates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from pagewright.functions import extract as E
from pagewright.functions.dims import BOTS, ENGINES, bots_dim, engines_dim
from pagewright.operators import checks as C
from pagewright.operators import geo as G
from pagewright.plans.audit import COUNTED, issues
from pagewright.plans.fixtures import BASE, changes, crawls, table
from pagewright.plans.registry import query

#: Columns of a report by its crawl's id; one rule for both sides.
REPORT_RULES = {
    "robots": "CASE crawl_id % 7 WHEN 0 THEN 'missing' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'unknown' ELSE 'read' END",
    "important": "crawl_id % 5", "html_important": "crawl_id % 3", "probes_conclusive": "crawl_id % 4 = 0", "has_content": "crawl_id % 6 <> 0",
    "llms_status": "CASE crawl_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 404 WHEN 2 THEN 429 WHEN 3 THEN 503 WHEN 4 THEN 0 ELSE 200 END",
    "llms_error": "CASE WHEN crawl_id % 9 = 4 THEN 'timeout' END",
    "llms_type": "CASE crawl_id % 5 WHEN 0 THEN 'Text/HTML; charset=utf-8' WHEN 1 THEN NULL ELSE 'text/plain' END",
    "llms_body": "CASE crawl_id % 8 WHEN 0 THEN ' <!DOCTYPE html><p>' WHEN 1 THEN 'words' ELSE '# Site' END",
    "valid_signals": "crawl_id % 6 % 3", "home_read": "crawl_id % 10 <> 3",
    "markdown": "CASE crawl_id % 4 WHEN 0 THEN 'served' WHEN 1 THEN 'not_served' WHEN 2 THEN 'unreachable' END",
}
_STATE = """CASE WHEN llms_status IS NULL THEN NULL WHEN llms_error IS NOT NULL OR llms_status = 429 THEN 'unavailable' WHEN llms_status BETWEEN 400 AND 499 THEN 'absent'
 WHEN llms_status BETWEEN 200 AND 299 THEN CASE WHEN llms_body LIKE '%<!DOCTYPE%' OR (coalesce(llms_type, '') LIKE 'Text/HTML%' AND llms_body NOT LIKE '# %') THEN 'soft_not_found' ELSE 'available' END ELSE 'unavailable' END"""
REPORTS = BASE + ", r0 AS (SELECT crawl_id, site_id, " + ", ".join(f"{e} AS {c}" for c, e in REPORT_RULES.items()) + f""" FROM crawls), r1 AS (SELECT *, {_STATE} AS llms_state FROM r0),
reports AS (SELECT *, coalesce(last_value(CASE llms_state WHEN 'available' THEN true WHEN 'absent' THEN false WHEN 'soft_not_found' THEN false END IGNORE NULLS)
  OVER (PARTITION BY site_id ORDER BY crawl_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS adopted FROM r1) """


def reports(spark, sf_dir):
    rows = crawls(spark, sf_dir).select("crawl_id", "site_id", F.col("crawl_id").alias("report"), *(F.expr(e).alias(c) for c, e in REPORT_RULES.items()))
    state = F.when(F.col("llms_status").isNotNull(), G.llms_state(F.col("llms_status"), F.col("llms_error"), F.col("llms_type"), F.col("llms_body")))
    return G.with_adoption(rows.withColumn("llms_state", state), "site_id", "crawl_id")


_F7 = "SELECT crawl_id AS report, 'warning' AS severity FROM reports WHERE llms_state = 'unavailable' AND adopted"
_F8 = "SELECT crawl_id AS report, 'notice' AS severity FROM reports WHERE robots IN ('read', 'missing') AND valid_signals = 0"
_F9 = "SELECT crawl_id AS report, 'notice' AS severity FROM reports WHERE home_read AND markdown = 'not_served'"


@query("f7", REPORTS + _F7)
def f7(spark, sf_dir):
    """An llms.txt that the site once served and that now fails."""
    return G.advice(reports(spark, sf_dir)).where("kind = 'llms_txt_unavailable'").select("report", "severity")


@query("f8", REPORTS + _F8)
def f8(spark, sf_dir):
    """Robots files without a valid content signal."""
    return G.advice(reports(spark, sf_dir)).where("kind = 'content_signals_missing'").select("report", "severity")


@query("f9", REPORTS + _F9)
def f9(spark, sf_dir):
    """Home pages without a Markdown version."""
    return G.advice(reports(spark, sf_dir)).where("kind = 'markdown_unavailable'").select("report", "severity")


_JUDGED = {
    "robots_unavailable": "robots <> 'unknown'", "bots_blocked": "v AND important > 0", "bots_not_blocked": "v AND important > 0", "answers_restricted": "html_important > 0",
    "fetch_blocked": "probes_conclusive", "content_missing": "has_content AND v", "llms_txt_unavailable": "llms_state IS NOT NULL", "content_signals_missing": "v",
    "markdown_unavailable": "home_read AND markdown IS NOT NULL AND markdown <> 'unreachable'",
}


@query("f10", REPORTS + ", w AS (SELECT *, robots IN ('read', 'missing') AS v FROM reports) " + " UNION ALL ".join(f"SELECT crawl_id AS report, '{k}' AS kind FROM w WHERE {p}" for k, p in _JUDGED.items()))
def f10(spark, sf_dir):
    """The kinds of findings that each report may judge."""
    return reports(spark, sf_dir).select("report", F.explode(G.evaluated_kinds()).alias("kind"))


#: An llms.txt for each page, with one thing or another missing.
_LLMS = """concat(CASE WHEN page_id % 10 = 3 THEN 'Intro\n' ELSE '' END, CASE WHEN page_id % 5 = 0 THEN '' ELSE concat('# ', host, '\n') END, CASE WHEN page_id % 3 = 0 THEN '' ELSE '\n> About\n' END,
 '\n## Docs\n', CASE WHEN page_id % 4 = 0 THEN 'none' ELSE concat('- [a](', url, ') and [b](/b)') END, CASE WHEN page_id % 7 = 0 THEN '\n## Empty\n```\n# no\n```' ELSE '' END)"""
_LLMS_FETCH = {"content_type": "CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'text/markdown; x=1' WHEN 2 THEN 'TEXT/PLAIN' ELSE 'text/html' END", "bytes": "page_id % 11 * 12000", "truncated": "page_id % 13 = 0", "checked": "page_id % 4", "failing": "page_id % 4 % 2"}
_LLMS_FILES = BASE + f", files AS (SELECT page_id, {_LLMS} AS text, " + ", ".join(f"{e} AS {c}" for c, e in _LLMS_FETCH.items()) + " FROM (SELECT page_id, url, host FROM p1)) "


def _parsed(parts):
    schema = pa.struct([("title", pa.string()), ("h1_first", pa.bool_()), ("summary", pa.string()), ("sections", pa.list_(pa.struct([("name", pa.string()), ("links", pa.list_(pa.string()))])))])
    for part in parts:
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array([E.llms_sections(t) for t in part.column(1).to_pylist()], schema)], names=[*part.schema.names, "doc"])


def llms_files(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "#.*$", "").alias("url"))
    pages = pages.withColumn("host", F.regexp_extract("url", "^https?://([^/?#]*)", 1))
    text = F.expr(_LLMS)
    rows = pages.select(F.col("page_id").cast("long").alias("file"), text.alias("text"), *(F.expr(e).alias(c) for c, e in _LLMS_FETCH.items()))
    rows = rows.select("file", "text", "content_type", F.col("bytes").cast("long").alias("bytes"), "truncated", F.col("checked").cast("long").alias("checked"), F.col("failing").cast("long").alias("failing"))
    return rows.mapInArrow(_parsed, f"file long, text string, content_type string, bytes long, truncated boolean, checked long, failing long, doc {E.LLMS_DDL}")


_LLMS_CHECKS = {
    "h1": "page_id % 5 <> 0 AND page_id % 10 <> 3", "summary": "page_id % 5 <> 0 AND page_id % 3 <> 0", "sections": "page_id % 4 <> 0", "links": "page_id % 4 <> 0", "length": "length(text) >= 50",
    "size": "NOT truncated AND bytes <= 102400", "mime": "page_id % 4 IN (1, 2)", "links_resolve": "failing = 0",
}


@query("f11", _LLMS_FILES + " UNION ALL ".join(f"SELECT page_id AS file, '{c}' AS \"check\", {p} AS passed FROM files" for c, p in _LLMS_CHECKS.items()))
def f11(spark, sf_dir):
    """The eight checks of an llms.txt."""
    return G.llms_checks(llms_files(spark, sf_dir))


_KEYS = ("search", "ai-input", "ai-train")
_DECLARED = "CASE (crawl_id / 4 + {n}) % 4 WHEN 0 THEN NULL WHEN 1 THEN 'yes' ELSE 'no' END"


@query("f14", BASE + ", d AS (" + " UNION ALL ".join(f"SELECT site_id, crawl_id, '{k}' AS key, {_DECLARED.format(n=i).replace('/ 4', '// 4')} AS value FROM crawls" for i, k in enumerate(_KEYS)) + """),
w AS (SELECT *, lag(value) OVER (PARTITION BY site_id, key ORDER BY crawl_id) AS before, row_number() OVER (PARTITION BY site_id, key ORDER BY crawl_id) AS n FROM d)
SELECT site_id, crawl_id AS report, key, before, value AS after FROM w WHERE n > 1 AND before IS DISTINCT FROM value""")
def f14(spark, sf_dir):
    """Declared preferences that changed from one report of a site to the next."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.expr(_DECLARED.format(n=i).replace("crawl_id / 4", "crawl_id div 4")).alias("value")) for i, k in enumerate(_KEYS)))
    declared = F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
    return G.preference_changes(crawls(spark, sf_dir).select("site_id", F.col("crawl_id").alias("report"), declared.alias("declared")), "site_id", "report")


#: How a product stands in a report; i is the engine's number.
_PRODUCT = {
    "home_allowed": "(crawl_id + i) % 4 <> 0", "blocked_pages": "(crawl_id + 2 * i) % 3 % 2", "limited_pages": "(crawl_id + i) % 5 % 2", "fetcher_gets_in": "(crawl_id + i) % 8 = 0",
    "fetched": "CASE (crawl_id + 3 * i) % 6 WHEN 0 THEN 'hard' WHEN 1 THEN 'soft' WHEN 2 THEN 'same' WHEN 3 THEN 'same' WHEN 4 THEN 'skipped' ELSE 'not_run' END",
    "stance": "CASE (crawl_id + i) % 3 WHEN 0 THEN 'allow' WHEN 1 THEN 'block' ELSE 'any' END",
}
_ENG = ", eng AS (SELECT * FROM (VALUES " + ", ".join(f"('{e[0]}', {i})" for i, e in enumerate(ENGINES)) + ") t(engine, i)) "
_KEPT = "(NOT home_allowed OR fetched = 'hard')"


@query("v2", REPORTS + _ENG + ", p AS (SELECT crawl_id, robots, engine, " + ", ".join(f"{e} AS {c}" for c, e in _PRODUCT.items()) + f""" FROM reports, eng)
SELECT crawl_id AS report, engine, CASE WHEN robots = 'unavailable' THEN 'blocked' WHEN robots = 'unknown' THEN 'unknown' WHEN {_KEPT} THEN CASE WHEN fetcher_gets_in THEN 'limited' ELSE 'blocked' END
 WHEN blocked_pages > 0 OR fetched = 'soft' OR limited_pages > 0 THEN 'limited' WHEN fetched = 'same' THEN 'reachable' ELSE 'allowed' END AS reach,
 CASE WHEN stance = 'any' THEN 'no_preference' WHEN stance = 'allow' THEN 'wanted' WHEN robots = 'unavailable' THEN 'per_policy' WHEN robots = 'unknown' THEN 'wanted' WHEN {_KEPT} THEN 'per_policy' ELSE 'policy_says_block' END AS fit FROM p""")
def v2(spark, sf_dir):
    """What each product can reach by each report, and whether that is wanted. The ten engines are joined to every report."""
    engines = spark.createDataFrame([(e[0], i) for i, e in enumerate(ENGINES)], "engine string, i int")
    rows = reports(spark, sf_dir).crossJoin(F.broadcast(engines)).select("report", "robots", "engine", *(F.expr(e).alias(c) for c, e in _PRODUCT.items()))
    return rows.select("report", "engine", G.product_reach().alias("reach"), G.product_fit().alias("fit"))


_BOT = {
    "stance": "CASE i % 3 WHEN 0 THEN 'allow' WHEN 1 THEN 'block' ELSE 'any' END", "allowed": "CASE WHEN i % 9 = 8 THEN NULL ELSE i % 4 <> 0 END", "blocked_pages": "CASE WHEN i % 5 = 1 THEN 2 ELSE 0 END",
    "problem": "CASE i % 7 WHEN 2 THEN 'hard' WHEN 6 THEN 'soft' END",
}
_BOTS_SQL = "WITH b AS (SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in _BOT.items()) + " FROM (VALUES " + ", ".join(f"('{b[0]}', '{b[1]}', {str(b[2] == 'yes').lower()}, {i})" for i, b in enumerate(BOTS)) + """) t(token, purpose, honours, i)),
s AS (SELECT *, CASE WHEN allowed IS NULL THEN '—' WHEN stance = 'allow' THEN CASE WHEN NOT allowed THEN 'Blocked' WHEN blocked_pages > 0 THEN 'Partly blocked' WHEN problem = 'hard' THEN 'Firewall blocks' WHEN problem = 'soft' THEN 'Treated differently' ELSE 'OK' END
 WHEN stance = 'block' THEN CASE WHEN NOT allowed THEN 'Blocked, as wanted' ELSE 'Not blocked' END WHEN NOT allowed THEN 'Blocked' ELSE 'Allowed (no preference)' END AS status FROM b),
a AS (SELECT *, (stance = 'allow' AND status NOT IN ('OK', '—')) OR (stance = 'block' AND status = 'Not blocked' AND honours) AS attention FROM s) """


@query("v4", _BOTS_SQL + "SELECT purpose AS group, token, status, attention, token = (SELECT token FROM a WHERE attention AND lower(token) LIKE '%bot%' ORDER BY purpose, token LIMIT 1) AS chosen FROM a WHERE attention AND lower(token) LIKE '%bot%'")
def v4(spark, sf_dir):
    """Bots that need attention, by purpose, that a search for "bot" finds; the one asked for is not among them."""
    order = spark.createDataFrame([(b[0], i) for i, b in enumerate(BOTS)], "token string, i int")
    bots = bots_dim(spark).join(order, "token").select("token", "purpose", (F.col("honours") == "yes").alias("honours"), *(F.expr(e).alias(c) for c, e in _BOT.items()))
    return G.bots_list(bots, "purpose", "BOT", True, "nobody")


@query("v10", COUNTED + """, f AS (SELECT DISTINCT 'finding:' || kind AS rule, CAST(site_id AS VARCHAR) AS subject, severity FROM changes WHERE change_id % 3 <> 0),
g AS (SELECT DISTINCT 'policy:' || kind AS rule, CAST(site_id AS VARCHAR) AS subject, severity FROM changes WHERE change_id % 7 = 0),
seen AS (SELECT DISTINCT 'finding:' || kind AS rule, CAST(site_id AS VARCHAR) AS subject FROM changes WHERE change_id % 9 = 1 UNION SELECT DISTINCT 'policy:' || kind, CAST(site_id AS VARCHAR) FROM changes WHERE change_id % 14 = 0)
SELECT slug AS rule, severity, affected AS n FROM counts WHERE severity <> 'notice'
UNION ALL SELECT rule, severity, count(*) FROM (SELECT * FROM f UNION ALL SELECT * FROM g) x WHERE severity <> 'notice' AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.rule = x.rule AND s.subject = x.subject) GROUP BY ALL""")
def v10(spark, sf_dir):
    """What trips a gate at warnings: checks, and findings and policy gaps that the baseline lacks."""
    rows = changes(spark, sf_dir).select("change_id", "kind", F.col("site_id").cast("string").alias("subject"), "severity")
    pick = lambda where, *c: rows.where(where).select(*c).distinct()
    findings, gaps = pick("change_id % 3 <> 0", "kind", "subject", "severity"), pick("change_id % 7 = 0", F.col("kind").alias("rule"), "subject", "severity")
    seen = pick("change_id % 9 = 1", F.concat(F.lit("finding:"), "kind").alias("rule"), "subject").unionByName(pick("change_id % 14 = 0", F.concat(F.lit("policy:"), "kind").alias("rule"), "subject"))
    return G.gate(C.affected(issues(spark, sf_dir)), findings, gaps, seen, ["critical", "warning"])


@query("src10", "SELECT * FROM (VALUES " + ", ".join(f"('{b[0]}', '{b[1]}', '{b[2]}', NULL)" for b in BOTS) + ", " + ", ".join(f"('{e[1]}', 'engine', NULL, '{e[0]}')" for e in ENGINES) + ") t(token, purpose, honours, engine)")
def src10(spark, sf_dir):
    """The built-in registry of bots and engines as a table."""
    bots = bots_dim(spark).select("token", "purpose", "honours", F.lit(None).cast("string").alias("engine"))
    return bots.unionByName(engines_dim(spark).select(F.col("crawler").alias("token"), F.lit("engine").alias("purpose"), F.lit(None).cast("string").alias("honours"), "engine"))


#: Incidents of the change table and what a report says of each; one rule for both sides.
_INCIDENT = {"step": "CASE change_id % 3 WHEN 0 THEN 'opened' WHEN 1 THEN 'updated' ELSE 'resolved' END", "escalated": "change_id % 2 = 0", "widened": "change_id % 5 = 0"}
_HELD = {"accepted": "change_id % 7 = 0", "snoozed": "change_id % 4 = 0", "escalation_due": "change_id % 11 = 0", "quiet": "change_id % 6 = 1"}


@query("i2", BASE + ", t AS (SELECT change_id, kind, " + ", ".join(f"{e} AS {c}" for c, e in _INCIDENT.items()) + ", " + ", ".join(f"CASE WHEN change_id % 3 = 0 THEN false ELSE {e} END AS {c}" for c, e in _HELD.items()) + """ FROM changes),
u AS (SELECT *, kind NOT IN ('title_changed') AS counts, kind IN ('new_url', 'title_changed') AS silent FROM t),
v AS (SELECT *, step = 'updated' AND counts AND escalated AND accepted AS unaccept FROM u),
w AS (SELECT *, unaccept OR (step = 'updated' AND counts AND escalation_due) OR (step = 'updated' AND counts AND (escalated OR widened) AND NOT accepted) AS announce FROM v)
SELECT change_id, step, CASE WHEN step = 'opened' THEN CASE WHEN NOT silent THEN 'written' END WHEN announce AND snoozed THEN 'muted' WHEN unaccept THEN 'written'
  WHEN (announce OR (step = 'resolved' AND NOT quiet)) AND NOT accepted THEN CASE WHEN snoozed THEN 'muted' ELSE 'written' END END AS change,
 CASE WHEN step = 'opened' THEN silent ELSE quiet AND NOT announce END AS quiet, accepted AND NOT unaccept AS accepted,
 CASE WHEN announce AND snoozed AND escalated THEN true WHEN announce AND NOT snoozed THEN false END AS snooze_escalated FROM w""")
def i2(spark, sf_dir):
    """What the transitions of incidents write: changes told, muted or none, and the incidents' next states."""
    rows = changes(spark, sf_dir).select("change_id", "kind")
    held = rows.where("change_id % 3 <> 0").select("change_id", *(F.expr(e).alias(c) for c, e in _HELD.items()))
    return G.incident_writes(rows.select("change_id", "kind", *(F.expr(e).alias(c) for c, e in _INCIDENT.items())), held, ["new_url"], ["title_changed"], ["change_id"])


@query("i4", BASE + """, p AS (SELECT site_id, kind, change_id, CASE WHEN change_id % 3 <> 0 THEN change_id % 400 = 1 END AS now_fails, change_id % 3 <> 0 AND change_id % 370 <> 2 AS sure FROM changes),
b AS (SELECT site_id, kind, count(*) AS pages, count(*) FILTER (sure) AS seen, count(*) FILTER (sure AND now_fails) AS failing FROM p GROUP BY ALL)
SELECT site_id, kind, CASE WHEN failing > 0 THEN 'still_failing' WHEN seen < pages THEN 'inconclusive' ELSE 'clean' END AS verdict, pages, seen FROM b""")
def i4(spark, sf_dir):
    """Rechecks of incidents (a site's kind): fresh answers stand in for stored ones."""
    planned = changes(spark, sf_dir).select("site_id", "kind", "change_id")
    fresh = planned.where("change_id % 3 <> 0").withColumn("fails", F.expr("change_id % 400 = 1")).withColumn("conclusive", F.expr("change_id % 370 <> 2"))
    return G.recheck_verdicts(planned, fresh, ["site_id", "kind"], "change_id")


@query("v7", BASE + """, s AS (SELECT 'lang-' || substr(path, 2, 2) || CASE WHEN page_id % 2 = 0 THEN '-a' ELSE '-b' END AS section, page_id, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg FROM cur),
x AS (SELECT page_id, section, n, array_to_string(seg[1:n], '/') AS prefix FROM s, LATERAL (SELECT unnest(range(1, len(seg) + 1)) AS n)),
h AS (SELECT n, prefix, min(section) AS section FROM x WHERE page_id % 5 = 0 GROUP BY ALL)
SELECT x.page_id, arg_max(h.section, x.n) AS section, CAST(max(x.n) AS INTEGER) AS shared FROM x JOIN h USING (n, prefix) WHERE x.page_id % 5 <> 0 GROUP BY 1""")
def v7(spark, sf_dir):
    """The section of an llms.txt that fits a page that it leaves out."""
    from pagewright.plans.fixtures import current

    pages = current(spark, sf_dir).select("page_id", "path")
    section = F.concat(F.lit("lang-"), F.substring("path", 2, 2), F.when(F.col("page_id") % 2 == 0, "-a").otherwise("-b"))
    return G.best_section(pages.where("page_id % 5 <> 0"), pages.where("page_id % 5 = 0").select(section.alias("section"), "path"))
