"""Robots verdicts, eligibility for answer engines, findings, scores and incidents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagewright.functions.dims import BOTS, ENGINES, bots_dim
from pagewright.operators import access as A
from pagewright.operators import robots as R
from pagewright.plans.fixtures import BASE, changes, current, previous
from pagewright.plans.registry import query

#: A robots file as lines; both sides read it from here.
ROBOTS_LINES = (
    "# site rules", "User-agent: *", "Disallow: /fr/1", "Allow: /fr/12", "Crawl-delay: 2", "", "User-agent: GPTBot", "User-agent: CCBot", "Disallow: /", "Allow: /en/9", "",
    "User-agent: Googlebot", "Disallow: /*/5", "Disallow: /de/*7$", "", "User-agent: ClaudeBot", "Disallow: /es/", "Allow: /es/2", "Disallow:", "",
    "User-agent: PerplexityBot", "Disallow: /en/*1$", "Sitemap: https://example.com/s.xml",
)
TOKENS = ["Googlebot", "GPTBot", "CCBot", "ClaudeBot", "PerplexityBot", "OAI-SearchBot"]
#: The same rules parsed by hand for the SQL side: group, agents, line, allow, pattern, anchored regular expression.
_RULES = (
    (1, "*", 3, False, "/fr/1", "^/fr/1"), (1, "*", 4, True, "/fr/12", "^/fr/12"), (2, "ccbot,gptbot", 9, False, "/", "^/"), (2, "ccbot,gptbot", 10, True, "/en/9", "^/en/9"),
    (3, "googlebot", 13, False, "/*/5", "^/.*/5"), (3, "googlebot", 14, False, "/de/*7$", "^/de/.*7$"), (4, "claudebot", 17, False, "/es/", "^/es/"),
    (4, "claudebot", 18, True, "/es/2", "^/es/2"), (5, "perplexitybot", 22, False, "/en/*1$", "^/en/.*1$"),
)
_RULES_SQL = ", rules AS (SELECT * FROM (VALUES " + ", ".join(f"({g}, '{a}', {n}, {str(w).lower()}, '{p}', '{x}')" for g, a, n, w, p, x in _RULES) + ") r(group_idx, agents, line, allow, pattern, rx))"
_TOKENS_SQL = ", tokens AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}')" for t in TOKENS) + ") t(token))"
_VERDICTS = _RULES_SQL + _TOKENS_SQL + """, named AS (SELECT t.token, r.* FROM tokens t JOIN rules r ON list_contains(string_split(r.agents, ','), lower(t.token))
 UNION ALL SELECT t.token, r.* FROM tokens t JOIN rules r ON r.agents = '*' WHERE lower(t.token) NOT IN (SELECT unnest(string_split(agents, ',')) FROM rules)),
hit AS (SELECT cur.page_id, n.token, n.allow, n.line, row_number() OVER (PARTITION BY cur.page_id, n.token ORDER BY length(n.pattern) DESC, n.allow DESC, n.line) AS r FROM cur JOIN named n ON regexp_matches(cur.path, n.rx)),
verdict AS (SELECT cur.page_id, t.token, coalesce(h.allow, true) AS allowed, CAST(h.line AS INTEGER) AS line FROM cur CROSS JOIN tokens t LEFT JOIN hit h ON h.page_id = cur.page_id AND h.token = t.token AND h.r = 1)
"""


def robots_rules(spark):
    return R.parsed(spark.createDataFrame([("\n".join(ROBOTS_LINES),)], "body string"), [])


_VERDICT_SQL = BASE + _VERDICTS


@query("j7", _VERDICT_SQL + "SELECT * FROM verdict")
def j7(spark, sf_dir):
    """Which bot may read which page, and by which line."""
    return R.verdicts(current(spark, sf_dir).select("page_id", "path"), TOKENS, robots_rules(spark))


@query("v6", _VERDICT_SQL + "SELECT token, allowed, line FROM verdict WHERE page_id = 5 AND token = 'Googlebot'")
def v6(spark, sf_dir):
    one = current(spark, sf_dir).where("page_id = 5").select("page_id", "path")
    return R.verdicts(one, ["Googlebot"], robots_rules(spark)).select("token", "allowed", "line")


@query("g8", _VERDICT_SQL + "SELECT token, CASE WHEN count(*) FILTER (NOT allowed) = 0 THEN 'allowed' WHEN count(*) FILTER (NOT allowed) = count(*) THEN 'blocked' ELSE 'partly' END AS state, count(*) FILTER (NOT allowed) AS blocked FROM verdict GROUP BY 1")
def g8(spark, sf_dir):
    """How far each bot reaches."""
    rows = R.verdicts(current(spark, sf_dir).select("page_id", "path"), TOKENS, robots_rules(spark))
    return rows.groupBy("token").agg(F.when(F.count_if(~F.col("allowed")) == 0, "allowed").when(F.count_if(~F.col("allowed")) == F.count("*"), "blocked").otherwise("partly").alias("state"), F.count_if(~F.col("allowed")).alias("blocked"))


@query("x8", "SELECT n_nationkey, CASE WHEN a = '*' THEN '*' ELSE lower(regexp_extract(a, '^[A-Za-z0-9_-]+')) END AS token FROM (SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN '*' WHEN 1 THEN concat(n_name, '/2.1 (+http)') ELSE concat('Bot-', n_name, ' x') END AS a FROM nation)")
def x8(spark, sf_dir):
    """The product token of an agent."""
    a = F.expr("CASE n_nationkey % 3 WHEN 0 THEN '*' WHEN 1 THEN concat(n_name, '/2.1 (+http)') ELSE concat('Bot-', n_name, ' x') END")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", a.alias("a"))
    return rows.select("n_nationkey", F.when(F.col("a") == "*", "*").otherwise(F.lower(F.regexp_extract("a", "^[A-Za-z0-9_-]+", 0))).alias("token"))


@query("x4", BASE + "SELECT page_id, list_sort(list_filter(list_transform(string_split(lower(coalesce(meta_robots, '')), ','), lambda w: trim(w)), lambda w: w <> '')) AS directives FROM cur")
def x4(spark, sf_dir):
    """Directives of a plain list."""
    return current(spark, sf_dir).select("page_id", F.array_sort(A.directives(F.col("meta_robots"), [])).alias("directives"))


@query("x4_scoped", BASE + "SELECT page_id, list_concat(['noarchive'], list_transform(string_split(coalesce(meta_robots, 'all'), ','), lambda w: trim(w))) AS directives FROM cur")
def x4_scoped(spark, sf_dir):
    """Directives under agents: a token with a colon scopes itself and what follows. The tests hold the cases."""
    value = F.concat(F.lit("noarchive, googlebot: "), F.coalesce("meta_robots", F.lit("all")), F.lit(", otherbot: noindex"))
    return current(spark, sf_dir).select("page_id", A.directives(value, ["googlebot"]).alias("directives"))


def _engine_words(k: int) -> str:
    return "(VALUES " + ", ".join(f"('{e[0]}', '{w}')" for e in ENGINES for w in e[k]) + ")"


_EFFECTS = f"""
, words AS (SELECT page_id, unnest(list_filter(list_transform(string_split(lower(coalesce(meta_robots, '')), ','), lambda w: trim(w)), lambda w: w <> '')) AS w FROM cur WHERE html_ok),
eng AS (SELECT * FROM (VALUES {", ".join(f"('{e[0]}', {str(e[4]).lower()}, {str(e[5]).lower()})" for e in ENGINES)}) e(engine, max_snippet, share_rule)),
hits AS (SELECT page_id, engine, 2 AS rank FROM words JOIN {_engine_words(2)} x(engine, w) USING (w) UNION ALL SELECT page_id, engine, 1 FROM words JOIN {_engine_words(3)} m(engine, w) USING (w)
 UNION ALL SELECT page_id, engine, CASE WHEN w = 'max-snippet:0' THEN 2 ELSE 1 END FROM words, eng WHERE max_snippet AND w LIKE 'max-snippet:%'
 UNION ALL SELECT page_id, engine, 1 FROM cur, eng WHERE html_ok AND share_rule AND nosnippet_words > 0 AND nosnippet_words * 100 >= 25 * greatest(word_count, nosnippet_words)),
effects AS (SELECT cur.page_id, eng.engine, coalesce(max(h.rank), 0) AS rank FROM cur CROSS JOIN eng LEFT JOIN hits h ON h.page_id = cur.page_id AND h.engine = eng.engine WHERE cur.html_ok GROUP BY ALL)
"""


@query("j8", BASE + _EFFECTS + "SELECT page_id, engine, CASE rank WHEN 2 THEN 'excluded' WHEN 1 THEN 'limited' ELSE 'eligible' END AS effect FROM effects")
def j8(spark, sf_dir):
    """What a page's directives mean to each answer engine."""
    return A.effects(current(spark, sf_dir)).select("page_id", "engine", "effect")


@query("f12", BASE + _EFFECTS + "SELECT engine, CAST(max(rank) AS INTEGER) AS worst FROM effects GROUP BY 1")
def f12(spark, sf_dir):
    """The worst effect per engine."""
    return A.effects(current(spark, sf_dir)).groupBy("engine").agg(F.max("rank").alias("worst"))


@query("a20", BASE + _EFFECTS + "SELECT engine, count(*) FILTER (rank = 2) AS excluded, count(*) FILTER (rank = 1) AS limited FROM effects GROUP BY 1")
def a20(spark, sf_dir):
    """Excluded and limited pages per engine."""
    return A.effects(current(spark, sf_dir)).groupBy("engine").agg(F.count_if(F.col("rank") == 2).alias("excluded"), F.count_if(F.col("rank") == 1).alias("limited"))


_BOTS_SQL = ", bots AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{p}', '{h}', {str(c).lower()}, {str(u).lower()})" for t, p, h, c, u in BOTS) + ") b(token, purpose, honours, crawls, has_ua))"
_INTENT = "(VALUES ('search', 'allow'), ('user_fetch', 'allow'), ('training', 'block'))"
_OVERRIDE = "(VALUES ('gptbot', 'allow'), ('bingbot', 'any'))"


@query("f13", BASE + _BOTS_SQL + f"SELECT b.token, coalesce(o.stance, i.stance, CASE WHEN b.purpose IN ('search', 'user_fetch') THEN 'allow' ELSE 'any' END) AS stance FROM bots b LEFT JOIN {_OVERRIDE} o(token, stance) ON o.token = lower(b.token) LEFT JOIN {_INTENT} i(purpose, stance) ON i.purpose = b.purpose")
def f13(spark, sf_dir):
    """What the owner wants of each bot: its own rule, else its purpose's, else the default."""
    return A.stances(spark, bots_dim(spark), {"training": "block"}, {"GPTBot": "allow", "Bingbot": "any"})


_WANT = f", st AS (SELECT b.*, coalesce(o.stance, i.stance, 'any') AS stance FROM bots b LEFT JOIN {_OVERRIDE} o(token, stance) ON o.token = lower(b.token) LEFT JOIN {_INTENT} i(purpose, stance) ON i.purpose = b.purpose)"
_BLOCKED = _VERDICTS + _BOTS_SQL + _WANT + """, reach AS (SELECT v.token, st.purpose, st.honours, st.stance, count(*) FILTER (NOT v.allowed) AS blocked, count(*) AS pages, bool_or(v.page_id = 0 AND NOT v.allowed) AS home FROM verdict v JOIN st ON st.token = v.token GROUP BY ALL)
"""


@query("f2", BASE + _BLOCKED + """SELECT purpose, CAST(min(CASE WHEN home AND honours = 'yes' THEN 0 WHEN honours = 'yes' THEN 1 ELSE 2 END) AS INTEGER) AS rank, string_agg(token, ',' ORDER BY token) AS members FROM reach WHERE stance = 'allow' AND blocked > 0 GROUP BY 1""")
def f2(spark, sf_dir):
    """Bots that the owner wants and robots.txt blocks, by purpose."""
    rows = _reach(spark, sf_dir).where("stance = 'allow' AND blocked > 0")
    rank = F.when(F.col("home") & (F.col("honours") == "yes"), 0).when(F.col("honours") == "yes", 1).otherwise(2)
    return rows.groupBy("purpose").agg(F.min(rank).alias("rank"), F.array_join(F.sort_array(F.collect_list("token")), ",").alias("members"))


def _reach(spark, sf_dir):
    verdicts = R.verdicts(current(spark, sf_dir).select("page_id", "path"), TOKENS, robots_rules(spark))
    reach = verdicts.groupBy("token").agg(F.count_if(~F.col("allowed")).alias("blocked"), F.count("*").alias("pages"), F.bool_or((F.col("page_id") == 0) & ~F.col("allowed")).alias("home"))
    wants = A.stances(spark, bots_dim(spark), {"training": "block"}, {"GPTBot": "allow", "Bingbot": "any"})
    return reach.join(F.broadcast(bots_dim(spark).join(wants, "token")), "token")


@query("a34", BASE + _BLOCKED + "SELECT purpose, count(*) FILTER (blocked > 0) AS bots, CAST(max(blocked) AS BIGINT) AS pages FROM reach GROUP BY 1")
def a34(spark, sf_dir):
    """Blocked bots by purpose."""
    return _reach(spark, sf_dir).groupBy("purpose").agg(F.count_if(F.col("blocked") > 0).alias("bots"), F.max("blocked").alias("pages"))


@query("f3", BASE + _BLOCKED + "SELECT token FROM reach WHERE stance = 'block' AND honours = 'yes' AND NOT home")
def f3(spark, sf_dir):
    """Bots that the owner does not want and that still get in."""
    return _reach(spark, sf_dir).where("stance = 'block' AND honours = 'yes' AND NOT home").select("token")


_F4 = _EFFECTS + """, restricted AS (SELECT engine, count(*) FILTER (rank = 2) AS excluded, count(*) FILTER (rank = 1) AS limited, count(*) AS pages, bool_or(page_id = 0 AND rank = 2) AS home FROM effects GROUP BY 1)
"""


@query("f4", BASE + _F4 + "SELECT engine, CASE WHEN home OR 2 * excluded >= pages THEN 'critical' WHEN excluded > 0 THEN 'warning' ELSE 'notice' END AS severity FROM restricted WHERE excluded + limited > 0")
def f4(spark, sf_dir):
    """Engines whose answers the pages' directives restrict."""
    return A.restricted(A.effects(current(spark, sf_dir))).select("engine", "severity")


@query("f1", BASE + _BOTS_SQL + _WANT + "SELECT page_id AS site, CASE WHEN (SELECT count(*) FROM st WHERE stance = 'allow' AND honours = 'yes') > 0 THEN 'critical' ELSE 'notice' END AS severity FROM cur WHERE status = 429 OR status >= 500")
def f1(spark, sf_dir):
    """Sites (here: pages as their robots files) whose robots.txt cannot be had."""
    wants = A.stances(spark, bots_dim(spark), {"training": "block"}, {"GPTBot": "allow", "Bingbot": "any"})
    wanted = bots_dim(spark).join(wants, "token").agg((F.count_if((F.col("stance") == "allow") & (F.col("honours") == "yes")) > 0).alias("w"))
    down = current(spark, sf_dir).where("status = 429 OR status >= 500").select(F.col("page_id").alias("site"))
    return down.crossJoin(F.broadcast(wanted)).select("site", F.when(F.col("w"), "critical").otherwise("notice").alias("severity"))


_SHELL = "CASE WHEN NOT html_ok OR word_count >= 50 THEN 'present' WHEN k % 5 = 0 OR (k % 7 = 0 AND h1_count = 0 AND (k % 2 = 0 OR k % 3 = 0)) THEN 'shell' WHEN h1_count = 0 AND outlinks_internal = 0 AND k % 3 = 0 THEN 'likely_shell' ELSE 'thin' END"


@query("f6", BASE + f"SELECT {_SHELL} AS content, count(*) AS pages FROM cur GROUP BY 1")
def f6(spark, sf_dir):
    """Pages by what they hold without scripts (mount empty: k % 5 = 0; notice: k % 7; mount: even; scripted: k % 3)."""
    k = F.col("k")
    state = A.content_state(F.col("html_ok"), F.col("word_count"), k % 5 == 0, k % 7 == 0, F.col("h1_count") > 0, k % 2 == 0, k % 3 == 0, F.col("outlinks_internal") > 0)
    return current(spark, sf_dir).groupBy(state.alias("content")).agg(F.count("*").alias("pages"))


_PROBE = """
, probe AS (SELECT p.page_id, b.bot, q.title AS base_title, CASE WHEN p.page_id % 19 = 2 THEN 503 ELSE 200 END AS base_status, p.page_id % 23 = 3 AS base_challenge,
 CASE WHEN (p.page_id + b.bot) % 11 = 1 THEN 0 WHEN (p.page_id + b.bot) % 11 = 2 THEN 429 WHEN (p.page_id + b.bot) % 11 = 3 THEN 403 ELSE 200 END AS status,
 (p.page_id + b.bot) % 13 = 1 AS challenge, (p.page_id * b.bot) % 2 = 0 AS dropped, CASE WHEN (p.page_id + b.bot) % 17 = 5 THEN p.next_url ELSE p.url END AS final, p.url,
 CASE WHEN (p.page_id + b.bot) % 14 = 6 THEN '' ELSE p.title END AS title, p.word_count, CASE WHEN (p.page_id + b.bot) % 14 = 7 THEN 10 ELSE p.word_count END AS words
 FROM cur p JOIN prv q USING (page_id), (VALUES (1), (2), (3)) b(bot))
"""
_PROBE_CASE = """CASE WHEN base_challenge OR base_status NOT BETWEEN 200 AND 299 THEN 'inconclusive' WHEN status = 0 AND dropped THEN 'blocked' WHEN status = 0 THEN 'inconclusive' WHEN challenge THEN 'challenged'
 WHEN status = 429 THEN 'throttled' WHEN status >= 400 THEN 'blocked' WHEN final <> url THEN 'diverted' WHEN title <> base_title AND (words * 2 < word_count OR title = '') THEN 'degraded' ELSE 'same' END"""


def _probes(spark, sf_dir):
    p = current(spark, sf_dir).select("page_id", "url", "next_url", "title", "word_count")
    q = previous(spark, sf_dir).select("page_id", F.col("title").alias("base_title"))
    rows = p.join(q, "page_id").withColumn("bot", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    s, t = "(page_id + bot)", F.expr
    return rows.withColumns({
        "base_status": t("CASE WHEN page_id % 19 = 2 THEN 503 ELSE 200 END"), "base_challenge": t("page_id % 23 = 3"), "status": t(f"CASE WHEN {s} % 11 = 1 THEN 0 WHEN {s} % 11 = 2 THEN 429 WHEN {s} % 11 = 3 THEN 403 ELSE 200 END"),
        "challenge": t(f"{s} % 13 = 1"), "dropped": t("(page_id * bot) % 2 = 0"), "final": t(f"CASE WHEN {s} % 17 = 5 THEN next_url ELSE url END"),
        "bot_title": t(f"CASE WHEN {s} % 14 = 6 THEN '' ELSE title END"), "words": t(f"CASE WHEN {s} % 14 = 7 THEN 10 ELSE word_count END"),
    })


@query("j23", BASE + _PROBE + f"SELECT page_id, bot, {_PROBE_CASE} AS verdict FROM probe")
def j23(spark, sf_dir):
    """What a bot got, against what a browser got."""
    return _probes(spark, sf_dir).select("page_id", "bot", A.probe_verdict().alias("verdict"))


_V1 = f", pv AS (SELECT page_id, bot, {_PROBE_CASE} AS verdict FROM probe)"
_V1_CASE = "CASE WHEN count(*) = 0 THEN 'not_run' WHEN count(*) FILTER (verdict <> 'inconclusive') = 0 THEN 'unjudged' WHEN count(*) FILTER (verdict IN ('blocked', 'challenged', 'diverted')) > 0 THEN 'hard' WHEN count(*) FILTER (verdict IN ('throttled', 'degraded')) > 0 THEN 'soft' ELSE 'same' END"


@query("v1", BASE + _PROBE + _V1 + f"SELECT bot, {_V1_CASE} AS state, count(*) FILTER (verdict NOT IN ('same', 'inconclusive')) AS worse, count(*) FILTER (verdict <> 'inconclusive') AS compared FROM pv GROUP BY 1")
def v1(spark, sf_dir):
    """Fetches of each bot rolled up."""
    rows = _probes(spark, sf_dir).select("bot", A.probe_verdict().alias("verdict"))
    v, n = F.col("verdict"), lambda c: F.count_if(c)
    state = F.when(n(v != "inconclusive") == 0, "unjudged").when(n(v.isin("blocked", "challenged", "diverted")) > 0, "hard").when(n(v.isin("throttled", "degraded")) > 0, "soft").otherwise("same")
    return rows.groupBy("bot").agg(state.alias("state"), n(~v.isin("same", "inconclusive")).alias("worse"), n(v != "inconclusive").alias("compared"))


@query("f5", BASE + _PROBE + _V1 + "SELECT verdict AS cause, CASE WHEN bool_or(page_id IN (0, 1)) AND verdict NOT IN ('throttled', 'degraded') THEN 'warning' ELSE 'notice' END AS severity, count(DISTINCT page_id) AS pages FROM pv WHERE verdict NOT IN ('same', 'inconclusive') GROUP BY 1")
def f5(spark, sf_dir):
    """Fetches that fail, by cause."""
    rows = _probes(spark, sf_dir).select("page_id", A.probe_verdict().alias("cause")).where("cause NOT IN ('same', 'inconclusive')").distinct()
    grave = F.bool_or(F.col("page_id").isin(0, 1)) & ~F.first("cause").isin("throttled", "degraded")
    return rows.groupBy("cause").agg(F.when(grave, "warning").otherwise("notice").alias("severity"), F.count("*").alias("pages"))


_GEO = "(VALUES ('robots_unavailable', 70, 15), ('bots_blocked', 70, 15), ('answers_restricted', 70, 15), ('bots_not_blocked', 70, 5), ('fetch_blocked', 70, 5), ('content_missing', 70, 5), ('jsonld_invalid', 30, 5), ('title_missing', 30, 5), ('description_missing', 30, 5), ('sitemap', 30, 5), ('llms_txt', 30, 1), ('content_signals', 30, 1), ('markdown_negotiation', 30, 1))"
_OUTCOMES = "(VALUES ('bots_blocked', 15, 0.5, false), ('answers_restricted', 5, 0.25, false), ('fetch_blocked', NULL, NULL, true), ('title_missing', 5, 1.0, false), ('llms_txt', 1, 1.0, false))"


@query("a21", BASE + f""", g AS (SELECT * FROM {_GEO} g(name, tier, weight)), o AS (SELECT * FROM {_OUTCOMES} o(name, cap, share, skipped)),
c AS (SELECT g.*, o.cap, o.share FROM g LEFT JOIN o USING (name) WHERE NOT coalesce(o.skipped, false)),
t AS (SELECT sum(tier) AS available FROM (SELECT DISTINCT tier FROM c)), tw AS (SELECT tier, sum(weight) AS w FROM c GROUP BY 1)
SELECT CAST(round(100 - sum(CASE WHEN cap IS NULL THEN 0 ELSE least(cap * (0.25 + 0.75 * share), weight) * (c.tier * 100.0 / t.available) / tw.w END)) AS INTEGER) AS geo_score FROM c JOIN tw ON tw.tier = c.tier, t""")
def a21(spark, sf_dir):
    """Score of access by answer engines from the outcomes of its checks."""
    outcomes = spark.sql(f"SELECT * FROM {_OUTCOMES} o(name, cap, share, skipped)")
    return A.geo_score(spark.sql(f"SELECT * FROM {_GEO} g(name, tier, weight)"), outcomes)


@query("v3", BASE + f"SELECT tier, CAST(sum(weight) AS BIGINT) AS possible, round(sum(weight - CASE WHEN cap IS NULL THEN 0 ELSE least(cap * (0.25 + 0.75 * share), weight) END)::DOUBLE, 6) AS earned FROM {_GEO} g(name, tier, weight) LEFT JOIN {_OUTCOMES} o(name, cap, share, skipped) USING (name) WHERE NOT coalesce(skipped, false) GROUP BY 1")
def v3(spark, sf_dir):
    """Points earned and possible per tier."""
    rows = A.geo_losses(spark.sql(f"SELECT * FROM {_GEO} g(name, tier, weight)"), spark.sql(f"SELECT * FROM {_OUTCOMES} o(name, cap, share, skipped)"))
    return rows.groupBy("tier").agg(F.sum("weight").cast("long").alias("possible"), F.round(F.sum(F.col("weight") - F.col("loss")).cast("double"), 6).alias("earned"))


@query("a22", BASE + "SELECT crawl_id, CAST(round(0.6 * health_score + 0.4 * (crawl_id % 101)) AS INTEGER) AS overall FROM crawls")
def a22(spark, sf_dir):
    """Overall score of both scores."""
    from pagewright.plans.fixtures import crawls

    return crawls(spark, sf_dir).select("crawl_id", F.round(0.6 * F.col("health_score") + 0.4 * (F.col("crawl_id") % 101)).cast("int").alias("overall"))


_OPEN = ", fnd AS (SELECT DISTINCT kind, CAST(site_id AS VARCHAR) AS subject, site_id % 3 AS rank, site_id * 2 AS members FROM changes WHERE created_at >= TIMESTAMP '2024-01-29 00:00:00'), inc AS (SELECT DISTINCT kind, CAST(site_id AS VARCHAR) AS subject, (site_id + 1) % 3 AS rank, site_id + 9 AS members FROM changes WHERE created_at < TIMESTAMP '2024-01-02 00:00:00')"


def _found(spark, sf_dir):
    rows = changes(spark, sf_dir)
    base = lambda df, rank, members: df.select("kind", F.col("site_id").cast("string").alias("subject"), F.expr(rank).alias("rank"), F.expr(members).alias("members")).distinct()
    return base(rows.where("created_at >= TIMESTAMP '2024-01-29 00:00:00'"), "site_id % 3", "site_id * 2"), base(rows.where("created_at < TIMESTAMP '2024-01-02 00:00:00'"), "(site_id + 1) % 3", "site_id + 9")


_RECONCILED = """SELECT coalesce(f.kind, i.kind) AS kind, coalesce(f.subject, i.subject) AS subject, CASE WHEN i.kind IS NULL THEN 'opened' WHEN f.kind IS NULL THEN 'resolved' ELSE 'updated' END AS step,
 coalesce(f.rank < i.rank, false) AS escalated, coalesce(f.members > i.members, false) AS widened FROM fnd f FULL JOIN inc i ON f.kind = i.kind AND f.subject = i.subject"""


@query("i1", BASE + _OPEN + f"SELECT * FROM ({_RECONCILED}) WHERE step <> 'resolved' OR kind <> 'new_url'")
def i1(spark, sf_dir):
    """Findings against open incidents; what was not judged this time (new_url) is not resolved."""
    found, held = _found(spark, sf_dir)
    return A.reconciled(found, held, F.col("kind") != "new_url")


@query("j11", BASE + _OPEN + f"SELECT kind, subject, step FROM ({_RECONCILED})")
def j11(spark, sf_dir):
    found, held = _found(spark, sf_dir)
    return A.reconciled(found, held, F.lit(True)).select("kind", "subject", "step")


@query("i3", BASE + _OPEN + f"SELECT kind, subject, CASE WHEN step = 'resolved' AND CAST(subject AS BIGINT) % 4 = 0 THEN 'held' ELSE step END AS step FROM ({_RECONCILED})")
def i3(spark, sf_dir):
    """As above, where incidents of subjects that could not be looked at (every fourth) are held."""
    found, held = _found(spark, sf_dir)
    rows = A.reconciled(found, held, F.lit(True))
    unseen = (F.col("step") == "resolved") & (F.col("subject").cast("long") % 4 == 0)
    return rows.select("kind", "subject", F.when(unseen, "held").otherwise(F.col("step")).alias("step"))


@query("i5", BASE + "SELECT c.change_id, max(p.change_id) AS before FROM changes c JOIN changes p ON p.site_id = c.site_id AND p.kind = c.kind AND (p.created_at, p.change_id) < (c.created_at, c.change_id) WHERE c.severity = 'critical' AND p.change_id = (SELECT arg_max(x.change_id, (x.created_at, x.change_id)) FROM changes x WHERE x.site_id = c.site_id AND x.kind = c.kind AND (x.created_at, x.change_id) < (c.created_at, c.change_id)) GROUP BY 1")
def i5(spark, sf_dir):
    """The evidence before: the last earlier record of the same site and kind."""
    w = Window.partitionBy("site_id", "kind").orderBy("created_at", "change_id")
    return changes(spark, sf_dir).withColumn("before", F.lag("change_id").over(w)).where("severity = 'critical' AND before IS NOT NULL").select("change_id", "before")


@query("i1_all", BASE + "SELECT site_id, kind, count(*) AS seen, min(created_at) AS opened_at, max(created_at) AS last_seen_at, max(created_at) < TIMESTAMP '2024-01-29 00:00:00' AS resolved FROM changes WHERE severity <> 'notice' GROUP BY 1, 2")
def i1_all(spark, sf_dir):
    """Incidents as they stand after a whole log."""
    rows = changes(spark, sf_dir).where("severity <> 'notice'").groupBy("site_id", "kind")
    return rows.agg(F.count("*").alias("seen"), F.min("created_at").alias("opened_at"), F.max("created_at").alias("last_seen_at"), (F.max("created_at") < F.expr("TIMESTAMP '2024-01-29 00:00:00'")).alias("resolved"))


_INDEX_RULES = "(VALUES (0, '^/en/1.*', 'keep_out'), (1, '^/en/.*', 'index'), (2, '^/fr/.*5$', 'keep_out'), (3, '^/fr/.*', 'index'))"
_PO2 = f", ruled AS (SELECT page_id, indexability, (SELECT arg_min(r.stance, r.p) FROM {_INDEX_RULES} r(p, rx, stance) WHERE regexp_full_match(path, rx)) AS stance FROM cur)"


@query("j9", BASE + _PO2 + "SELECT page_id, stance FROM ruled WHERE stance IS NOT NULL")
def j9(spark, sf_dir):
    """The first index rule that a page's path meets."""
    return A.first_rule(current(spark, sf_dir), [("/en/1*", "keep_out"), ("/en/*", "index"), ("/fr/*5", "keep_out"), ("/fr/*", "index")]).where("stance IS NOT NULL").select("page_id", "stance")


@query("po2", BASE + _PO2 + "SELECT coalesce(stance, 'none') AS stance, count(*) AS pages, count(*) FILTER ((stance = 'index' AND indexability <> 'indexable') OR (stance = 'keep_out' AND indexability = 'indexable')) AS mismatches FROM ruled GROUP BY 1")
def po2(spark, sf_dir):
    """Index rules and the pages that do otherwise."""
    rows = A.first_rule(current(spark, sf_dir), [("/en/1*", "keep_out"), ("/en/*", "index"), ("/fr/*5", "keep_out"), ("/fr/*", "index")])
    wrong = F.expr("(stance = 'index' AND indexability <> 'indexable') OR (stance = 'keep_out' AND indexability = 'indexable')")
    return rows.groupBy(F.coalesce("stance", F.lit("none")).alias("stance")).agg(F.count("*").alias("pages"), F.count_if(wrong).alias("mismatches"))


@query("po1", BASE + "SELECT page_id, CASE WHEN url LIKE 'http://%' THEN 'scheme' WHEN host LIKE 'www.%' THEN 'host' WHEN path LIKE '%/' AND path <> '/' THEN 'slash' END AS gap FROM cur WHERE status BETWEEN 200 AND 299 AND (url LIKE 'http://%' OR host LIKE 'www.%' OR (path LIKE '%/' AND path <> '/'))")
def po1(spark, sf_dir):
    """Pages not at their preferred address: https, no www., no last slash."""
    gap = A.address_gap("https", False, False)
    return current(spark, sf_dir).where("status BETWEEN 200 AND 299").select("page_id", gap.alias("gap")).where("gap IS NOT NULL")


@query("po3", BASE + "SELECT page_id, lower(split_part(p, '=', 1)) AS param FROM (SELECT page_id, unnest(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&')) AS p FROM cur WHERE url LIKE '%?%') WHERE lower(split_part(p, '=', 1)) LIKE 'utm_%' OR lower(split_part(p, '=', 1)) = 'ref'")
def po3(spark, sf_dir):
    """Parameters that a policy ignores."""
    p = F.explode(F.split(F.regexp_extract("url", r"[?]([^#]*)", 1), "&"))
    rows = current(spark, sf_dir).where(F.col("url").contains("?")).select("page_id", p.alias("p"))
    name = F.lower(F.split_part("p", F.lit("="), F.lit(1)))
    return rows.select("page_id", name.alias("param")).where(F.col("param").rlike("^(utm_.*|utm..*|ref)$"))


@query("po4", BASE + """, chain AS (SELECT page_id, url AS at_url, 0 AS hops FROM cur WHERE page_id IN (0, 3, 10, 17, 27, 30, 34) UNION ALL SELECT c.page_id, t.redirect_target, c.hops + 1 FROM chain c JOIN cur t ON t.url = c.at_url WHERE t.redirect_target IS NOT NULL AND c.hops < 10)
SELECT c.page_id, CASE WHEN t.url IS NULL THEN 'not_checked' WHEN t.indexability = 'indexable' THEN 'works' ELSE t.indexability END AS verdict FROM chain c LEFT JOIN cur t ON t.url = c.at_url WHERE t.redirect_target IS NULL""")
def po4(spark, sf_dir):
    """Pages that must work: where they end, and whether that is a page open to the index."""
    from pagewright.operators.graph import final_target

    pages = current(spark, sf_dir)
    wanted = pages.where(F.col("page_id").isin(0, 3, 10, 17, 27, 30, 34))
    straight = wanted.where("redirect_target IS NULL").select("page_id", F.col("url").alias("final_url"))
    moved = final_target(pages).join(wanted.select("page_id"), "page_id", "left_semi").select("page_id", "final_url")
    end = pages.select(F.col("url").alias("final_url"), "indexability")
    rows = straight.unionByName(moved).join(end, "final_url", "left")
    return rows.select("page_id", F.when(F.col("indexability").isNull(), "not_checked").when(F.col("indexability") == "indexable", "works").otherwise(F.col("indexability")).alias("verdict"))


@query("j10", BASE + "SELECT page_id, CAST(min(p) AS INTEGER) AS rule FROM cur JOIN (VALUES (0, '^/en/1.*'), (1, '^/.*5$'), (2, '^/de/.*')) e(p, rx) ON regexp_full_match(path, rx) WHERE status <> 0 AND response_ms > 1000 GROUP BY 1")
def j10(spark, sf_dir):
    """The first exception that covers a slow page."""
    rules = A.first_rule(current(spark, sf_dir).where("status <> 0 AND response_ms > 1000"), [("/en/1*", 0), ("/*5", 1), ("/de/*", 2)], "rule")
    return rules.where("rule IS NOT NULL").select("page_id", "rule")


@query("a23", BASE + "SELECT count(*) AS pages, count(*) FILTER (response_ms > 1000 AND status <> 0 AND NOT excepted) AS slow FROM (SELECT *, regexp_full_match(path, '^/en/1.*') OR regexp_full_match(path, '^/.*5$') AS excepted FROM cur WHERE NOT regexp_full_match(path, '^/fr/.*5$'))")
def a23(spark, sf_dir):
    """Counts that score: without exceptions, and without pages kept out on purpose."""
    rows = A.first_rule(current(spark, sf_dir), [("/en/1*", 0), ("/*5", 1)], "rule").where(~F.col("path").rlike("^/fr/.*5$"))
    return rows.agg(F.count("*").alias("pages"), F.count_if(F.expr("response_ms > 1000 AND status <> 0 AND rule IS NULL")).alias("slow"))


@query("x20", BASE + r"SELECT page_id, CASE WHEN length(t) > 30 THEN concat(substr(t, 1, 29), '…') ELSE t END AS line FROM (SELECT page_id, trim(regexp_replace(title, '[\x00-\x1f ]+', ' ', 'g')) AS t FROM cur)")
def x20(spark, sf_dir):
    """A title on one line, clipped with an ellipsis."""
    t = F.trim(F.regexp_replace("title", r"[\x00-\x1f ]+", " "))
    return current(spark, sf_dir).select("page_id", F.when(F.length(t) > 30, F.concat(F.substring(t, 1, 29), F.lit("…"))).otherwise(t).alias("line"))


_SIGNAL = "concat('search=', CASE WHEN page_id % 2 = 0 THEN 'yes' ELSE 'no' END, ', ai-train = ', CASE WHEN page_id % 3 = 0 THEN 'no' ELSE 'yes' END, ',bad')"


@query("x12", BASE + f"SELECT page_id, trim(split_part(p, '=', 1)) AS key, trim(split_part(p, '=', 2)) = 'yes' AS allowed FROM (SELECT page_id, unnest(string_split({_SIGNAL}, ',')) AS p FROM cur) WHERE p LIKE '%=%'")
def x12(spark, sf_dir):
    """Content signals: key and consent."""
    rows = current(spark, sf_dir).select("page_id", F.explode(F.split(F.expr(_SIGNAL), ",")).alias("p")).where(F.col("p").contains("="))
    part = lambda n: F.trim(F.split_part("p", F.lit("="), F.lit(n)))
    return rows.select("page_id", part(1).alias("key"), (part(2) == "yes").alias("allowed"))
