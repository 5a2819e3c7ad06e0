"""Robots files of many sites: rules, verdicts, readers, fingerprints.

The files are made from pages: a site is a host with 500 pages at most, and each of its pages gives a line of its file.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import robots as R
from pagewright.plans.access import TOKENS
from pagewright.plans.registry import query

#: The beginning of every file.
HEAD = ("User-agent: *", "Disallow: /*/9", "Disallow: /private", "")
#: One rule for both engines: the site of a page, the path of its address and its line of the site's file.
_SITE = "concat(regexp_extract(url, '^https?://([^/?#]*)', 1), ':', CAST(8000 + floor(page_id / 500) AS INTEGER))"
_PATH = "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"
_AGENT = "CASE CAST(floor(page_id / 11) AS INTEGER) % 7 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TOKENS)) + " ELSE '*' END"
_LINE = (
    f"CASE page_id % 11 WHEN 0 THEN concat('User-agent: ', {_AGENT}, '/1.0 (+x)') WHEN 1 THEN concat('disallow : ', path, ' # ', page_id) WHEN 2 THEN concat('Allow: ', substr(path, 1, 4), '*') "
    "WHEN 3 THEN concat('Disallow: ', substr(path, 1, 3), '*', substr(path, length(path), 1), '$') WHEN 4 THEN concat('# ', path) WHEN 5 THEN concat('Disallow: ', substr(path, 2, 3)) "
    "WHEN 6 THEN concat('Sitemap: ', url) WHEN 7 THEN 'Disallow:' WHEN 8 THEN concat('Allow: ', path, '$') WHEN 9 THEN 'Crawl-delay: 3' ELSE concat('Disallow: *', substr(path, length(path) - 1, 2)) END"
)


def _lines(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.expr(_SITE).alias("site"), F.expr(_PATH).alias("path"))
    return pages.withColumn("text", F.expr(_LINE))


def site_files(spark, sf_dir, seen: str = "true"):
    """site, body: at most 500 pages make a file."""
    lines = F.array_sort(F.collect_list(F.struct("page_id", "text")))
    body = F.concat_ws("\n", F.array(*map(F.lit, HEAD)), F.transform(lines, lambda x: x["text"]))
    return _lines(spark, sf_dir).where(seen).groupBy("site").agg(body.alias("body"))


_FILES = (
    f"WITH paths AS (SELECT page_id, url, {_SITE} AS site, {_PATH} AS path FROM pages), "
    f"body AS (SELECT site, page_id, {_LINE} AS text FROM paths), "
    "lines AS (SELECT site, CAST(row_number() OVER (PARTITION BY site ORDER BY page_id) AS INTEGER) AS line, text FROM (SELECT site, page_id, text FROM body UNION ALL SELECT site, n, text FROM (SELECT DISTINCT site FROM body), (VALUES "
    + ", ".join(f"({i - len(HEAD)}, '{t}')" for i, t in enumerate(HEAD)) + ") h(n, text))), "
    "fields AS (SELECT site, line, lower(trim(split_part(t, ':', 1))) AS field, trim(substr(t, strpos(t, ':') + 1)) AS value FROM (SELECT *, split_part(text, '#', 1) AS t FROM lines) WHERE t LIKE '%:%'), "
    "kinds AS (SELECT *, field = 'user-agent' AND NOT coalesce(lag(field = 'user-agent') OVER (PARTITION BY site ORDER BY line), false) AS opens FROM fields WHERE field <> 'sitemap'), "
    "grouped AS (SELECT *, CAST(sum(CAST(opens AS INTEGER)) OVER (PARTITION BY site ORDER BY line) AS INTEGER) AS group_idx FROM kinds), "
    "agents AS (SELECT DISTINCT site, group_idx, CASE WHEN value LIKE '*%' THEN '*' ELSE lower(regexp_extract(value, '^[A-Za-z0-9_-]*')) END AS agent FROM grouped WHERE field = 'user-agent'), "
    "rules AS (SELECT site, group_idx, line, field = 'allow' AS allow, CASE WHEN value LIKE '/%' OR value LIKE '*%' THEN value ELSE '/' || value END AS pattern FROM grouped WHERE field IN ('allow', 'disallow') AND value <> '' AND group_idx > 0), "
    "tokens AS (SELECT unnest([" + ", ".join(f"'{t}'" for t in TOKENS) + "]) AS token), "
    "sites AS (SELECT DISTINCT site FROM body), "
    "own AS (SELECT site, token, agent FROM agents JOIN tokens ON agent = lower(token)), "
    "follows AS (SELECT DISTINCT s.site, t.token, coalesce(o.agent, '*') AS agent FROM sites s CROSS JOIN tokens t LEFT JOIN own o ON o.site = s.site AND o.token = t.token), "
    "hit AS (SELECT p.page_id, f.token, r.allow, r.line, row_number() OVER (PARTITION BY p.page_id, f.token ORDER BY strlen(r.pattern) DESC, r.allow DESC, r.line) AS k "
    "FROM paths p JOIN follows f USING (site) JOIN agents a USING (site, agent) JOIN rules r USING (site, group_idx) "
    r"WHERE regexp_matches(p.path, '^' || replace(regexp_replace(rtrim(r.pattern, '$'), '([\\.+?^{}()|\[\]])', '\\\1', 'g'), '*', '.*') || CASE WHEN r.pattern LIKE '%$' THEN '$' ELSE '' END)), "
    "verdict AS (SELECT p.page_id, p.site, t.token, coalesce(h.allow, true) AS allowed, h.line FROM paths p CROSS JOIN tokens t LEFT JOIN hit h ON h.page_id = p.page_id AND h.token = t.token AND h.k = 1) "
)


@query("x7", _FILES + "SELECT r.site, r.group_idx, (SELECT string_agg(a.agent, ',' ORDER BY a.agent) FROM agents a WHERE a.site = r.site AND a.group_idx = r.group_idx) AS agents, line, allow, pattern, CAST(strlen(pattern) AS INTEGER) AS length FROM rules r")
def x7(spark, sf_dir):
    """Rules of every site's robots file."""
    rows = R.parsed(site_files(spark, sf_dir), ["site"]).where("pattern is not null")
    return rows.select("site", "group_idx", F.array_join("agents", ",").alias("agents"), "line", "allow", "pattern", "length")


def _verdicts(spark, sf_dir):
    paths = _lines(spark, sf_dir).select("page_id", "site", "path")
    return R.verdicts(paths, TOKENS, R.parsed(site_files(spark, sf_dir), ["site"]), by=["site"])


@query("j7_sites", _FILES + "SELECT page_id, token, allowed, line FROM verdict")
def j7_sites(spark, sf_dir):
    """Which bot may read which page by its own site's file, and by which line."""
    return _verdicts(spark, sf_dir)


@query("g8_sites", _FILES + "SELECT site, token, CASE WHEN count(*) FILTER (NOT allowed) = 0 THEN 'allowed' WHEN count(*) FILTER (NOT allowed) = count(*) THEN 'blocked' ELSE 'partly' END AS state, count(*) FILTER (NOT allowed) AS blocked FROM verdict GROUP BY 1, 2")
def g8_sites(spark, sf_dir):
    """How far each bot reaches on each site."""
    sites = _lines(spark, sf_dir).select("page_id", "site")
    rows = _verdicts(spark, sf_dir).join(sites, "page_id").groupBy("site", "token")
    state = F.when(F.count_if(~F.col("allowed")) == 0, "allowed").when(F.count_if(~F.col("allowed")) == F.count("*"), "blocked").otherwise("partly")
    return rows.agg(state.alias("state"), F.count_if(~F.col("allowed")).alias("blocked"))


@query("v5", _FILES + ", named AS (SELECT a.site, a.group_idx, count(*) AS readers FROM agents a JOIN follows f USING (site, agent) GROUP BY 1, 2) SELECT g.site, g.group_idx, coalesce(n.readers, 0) AS readers FROM (SELECT DISTINCT site, group_idx FROM agents) g LEFT JOIN named n USING (site, group_idx)")
def v5(spark, sf_dir):
    """How many of the bots read each group: those that it names, and those that no group of the file names."""
    groups = R.parsed(site_files(spark, sf_dir), ["site"]).select("site", "group_idx", "agents").distinct()
    bots = F.array(*(F.lit(t.lower()) for t in TOKENS))
    # The names of a file are at most its lines; an agent counts once, however many groups name it.
    named = groups.groupBy("site").agg(F.array_distinct(F.flatten(F.collect_list("agents"))).alias("named"))
    own = F.size(F.array_intersect("agents", bots))
    rest = F.when(F.array_contains("agents", "*"), F.size(F.array_except(bots, "named"))).otherwise(0)
    return groups.join(named, "site").select("site", "group_idx", (own + rest).cast("long").alias("readers"))


def _fingerprint(body):
    """Digest of a file without comments, blanks and sitemap lines, fields in small letters."""
    lines = F.transform(F.split(body, "\n"), lambda t: F.trim(F.split_part(t, F.lit("#"), F.lit(1))))
    field = lambda t: F.lower(F.trim(F.split_part(t, F.lit(":"), F.lit(1))))
    value = lambda t: F.when(F.contains(t, F.lit(":")), F.trim(F.substring(t, F.instr(t, ":") + 1, F.length(t)))).otherwise("")
    kept = F.filter(lines, lambda t: (t != "") & (field(t) != "sitemap"))
    return F.sha2(F.array_join(F.transform(kept, lambda t: F.concat(field(t), F.lit(":"), value(t))), "\n"), 256)


_PRINT = (
    "SELECT site, sha256(string_agg(field || ':' || value, chr(10) ORDER BY n)) AS print FROM (SELECT site, n, lower(trim(split_part(t, ':', 1))) AS field, CASE WHEN t LIKE '%:%' THEN trim(substr(t, strpos(t, ':') + 1)) ELSE '' END AS value "
    "FROM (SELECT site, n, trim(split_part(text, '#', 1)) AS t FROM (SELECT site, page_id AS n, text FROM body WHERE {seen} UNION ALL SELECT site, n, text FROM (SELECT DISTINCT site FROM body WHERE {seen}), (VALUES "
    + ", ".join(f"({i - len(HEAD)}, '{t}')" for i, t in enumerate(HEAD)) + ") h(n, text))) WHERE t <> '') WHERE field <> 'sitemap' GROUP BY site"
)
_BEFORE, _AFTER = "page_id % 19 <> 0", "page_id % 23 <> 0"


@query("d3", _FILES + f"SELECT coalesce(b.site, a.site) AS site, b.print AS before, a.print AS after, CASE WHEN b.print IS NULL THEN 'added' WHEN a.print IS NULL THEN 'removed' WHEN a.print = b.print THEN 'same' ELSE 'rules changed' END AS change FROM ({_PRINT.format(seen=_BEFORE)}) b FULL JOIN ({_PRINT.format(seen=_AFTER)}) a ON a.site = b.site")
def d3(spark, sf_dir):
    """Fingerprints of each site's file in two crawls, and what became of it."""
    before, after = (site_files(spark, sf_dir, seen).select("site", _fingerprint(F.col("body")).alias(c)) for seen, c in ((_BEFORE, "before"), (_AFTER, "after")))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") == F.col("after"), "same").otherwise("rules changed")
    return before.join(after, "site", "full").select("site", "before", "after", change.alias("change"))
