"""Policy checks as bits of the mask, and the policy's rules on bots."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions.dims import BITS, BOTS, CHECKS, SEVERITY_POINTS, bots_dim
from pagewright.operators import access as A
from pagewright.operators import checks as C
from pagewright.operators import policy as P
from pagewright.plans.audit import FAILED
from pagewright.plans.fixtures import BASE, edges, narrow
from pagewright.plans.registry import ORACLE, QUERIES, query


def policy_of(pages) -> P.Policy:
    """The policy of the test site: its form of address is that of page 0, pages that must work are a few of its own."""
    few = {r.page_id: r for r in pages.where(F.col("page_id").isin(0, 3, 10, 17, 27, 30, 34)).select("page_id", "url", "host").collect()}
    return P.Policy(
        "https", few[0].host.removeprefix("www.") if 0 in few else "", "without", (("/en/1*", "keep_out"), ("/en/*", "index"), ("/fr/*5", "keep_out"), ("/fr/*", "index")),
        ("utm_*", "ref"), "page", tuple(r.url for _, r in sorted(few.items())) + ("https://nowhere.example/",),
    )


_OFF = """CASE WHEN NOT {0} LIKE 'https://%' THEN 'scheme' WHEN lower(regexp_extract({0}, '^[a-z]+://([^/?#:]*)', 1)) <> (SELECT regexp_replace(host, '^www[.]', '') FROM cur WHERE page_id = 0) THEN 'host'
 WHEN regexp_extract({0}, '^[a-z]+://[^/?#]*([^?#]*)', 1) LIKE '_%/' THEN 'slash' END"""
_IGNORED = "list_distinct(list_filter(list_transform(string_split(regexp_extract({0}, '[?]([^#]*)', 1), '&'), lambda p: split_part(p, '=', 1)), lambda n: n <> '' AND (lower(n) LIKE 'utm@_%' ESCAPE '@' OR lower(n) = 'ref')))"
_ENDS = """, chain AS (SELECT page_id, redirect_target AS at_url, 1 AS hops FROM cur WHERE redirect_target IS NOT NULL
 UNION ALL SELECT c.page_id, t.redirect_target, c.hops + 1 FROM chain c JOIN cur t ON t.url = c.at_url WHERE t.redirect_target IS NOT NULL AND c.hops < 10),
ends AS (SELECT c.page_id, c.at_url FROM chain c LEFT JOIN cur t ON t.url = c.at_url WHERE t.redirect_target IS NULL)"""
_STANCE = "CASE WHEN regexp_full_match(path, '^/en/1.*') THEN 'keep_out' WHEN regexp_full_match(path, '^/en/.*') THEN 'index' WHEN regexp_full_match(path, '^/fr/.*5$') THEN 'keep_out' WHEN regexp_full_match(path, '^/fr/.*') THEN 'index' END"
_WANTED = "(SELECT url FROM cur WHERE page_id IN (0, 3, 10, 17, 27, 30, 34))"
_WORKS = f""", wanted AS (SELECT url FROM {_WANTED} UNION ALL SELECT 'https://nowhere.example/'),
went AS (SELECT w.url, coalesce(e.at_url, w.url) AS final_url FROM wanted w LEFT JOIN cur s ON s.url = w.url LEFT JOIN ends e ON e.page_id = s.page_id),
works AS (SELECT w.url, t.page_id, CASE WHEN t.page_id IS NULL THEN 'not_checked' WHEN t.status = 0 AND t.indexability = 'blocked_by_robots' THEN 'blocked by robots.txt' WHEN t.status = 0 THEN coalesce(t.error, 'could not be fetched')
  WHEN t.status NOT BETWEEN 200 AND 299 THEN CAST(t.status AS VARCHAR) WHEN t.indexability = 'indexable' THEN 'works' ELSE t.indexability END AS verdict FROM went w LEFT JOIN cur t ON t.url = w.final_url)"""
POLICY_SQL = {
    "policy_address": f"""SELECT page_id FROM cur WHERE html_ok AND ({_OFF.format('url')} IS NOT NULL OR canonical IS NOT NULL AND {_OFF.format('canonical')} IS NOT NULL)
 UNION SELECT c.page_id FROM cur c JOIN ends e USING (page_id) WHERE c.status BETWEEN 300 AND 399 AND {_OFF.format('e.at_url')} IS NOT NULL
 UNION SELECT e.from_id FROM edges e JOIN cur t ON t.page_id = e.to_id JOIN cur s ON s.page_id = e.from_id WHERE e.from_id <> e.to_id AND s.html_ok AND t.status BETWEEN 300 AND 399 AND {_OFF.format('t.url')} IS NOT NULL""",
    "policy_index_mismatch": f"SELECT page_id FROM (SELECT *, {_STANCE} AS stance FROM cur WHERE html_ok OR indexability = 'blocked_by_robots') WHERE (stance = 'keep_out' AND indexability = 'indexable') OR (stance = 'index' AND indexability <> 'indexable')",
    "policy_keep_out_partial": f"SELECT page_id FROM (SELECT *, {_STANCE} AS stance FROM cur) WHERE stance = 'keep_out' AND indexability = 'blocked_by_robots'",
    "policy_param_canonical": f"SELECT page_id FROM cur WHERE html_ok AND len({_IGNORED.format('url')}) > 0 AND (indexability = 'indexable' OR (indexability = 'canonicalised' AND len({_IGNORED.format('canonical')}) > 0))",
    "must_work_failed": "SELECT DISTINCT page_id FROM works WHERE page_id IS NOT NULL AND verdict <> 'works'",
}
_MARKS = BASE + _ENDS + _WORKS


def _one_check(slug: str):
    def run(spark, sf_dir):
        pages = narrow(spark, sf_dir)
        policy = policy_of(pages)
        if slug == "policy_address":
            return P.address_pages(pages, edges(spark, sf_dir), policy)
        if slug == "policy_param_canonical":
            return P.param_pages(pages, policy).select("page_id")
        if slug == "must_work_failed":
            return P.must_work_rows(pages, policy).where("page_id IS NOT NULL AND verdict <> 'works'").select("page_id").distinct()
        return P.index_marks(pages, policy).where(F.col("slug") == slug).select("page_id")

    return run


for _slug, _sql in POLICY_SQL.items():
    QUERIES[f"check_{_slug}"] = _one_check(_slug)
    ORACLE[f"check_{_slug}"] = f"{_MARKS} {_sql}"

_FAILED_TOO = FAILED.replace("), failed AS (", ")" + _ENDS + _WORKS + ", failed AS (", 1) if "), failed AS (" in FAILED else FAILED.replace(", failed AS (", _ENDS + _WORKS + ", failed AS (", 1)
_FAILED_TOO += ", marked AS (" + " UNION ALL ".join(f"SELECT page_id, {BITS[s]} AS bit FROM ({q})" for s, q in POLICY_SQL.items()) + "), every AS (SELECT page_id, bit FROM failed UNION ALL SELECT page_id, bit FROM marked)"


def all_issues(spark, sf_dir):
    """Masks with the policy's bits."""
    pages, links = narrow(spark, sf_dir), edges(spark, sf_dir)
    return P.with_policy(C.issues(pages, links), P.policy_issues(pages, links, policy_of(pages)))


@query("issues_policy", _FAILED_TOO + "SELECT cur.page_id, CAST(coalesce(sum(1::BIGINT << bit), 0) AS BIGINT) AS issues FROM cur LEFT JOIN every USING (page_id) GROUP BY ALL")
def issues_policy(spark, sf_dir):
    return all_issues(spark, sf_dir)


_DIM = ", dim AS (SELECT * FROM (VALUES " + ", ".join(f"({b}, '{s}', '{v}', '{c}', {SEVERITY_POINTS[v]})" for b, s, v, c in CHECKS) + ") t(bit, slug, severity, scope, points))"


@query("a2_policy", _FAILED_TOO + _DIM + """, counts AS (SELECT d.bit, any_value(d.points) AS points, count(*) AS affected FROM every JOIN dim d USING (bit) GROUP BY 1)
SELECT CAST(round(greatest(0, 100 - coalesce(sum(points * (0.25 + 0.75 * least(1.0, affected / greatest(p.pages, 1)::DOUBLE))), 0))) AS INTEGER) AS health_score FROM counts, (SELECT count(*) AS pages FROM cur) p""")
def a2_policy(spark, sf_dir):
    """Health score with the policy's checks."""
    masks = all_issues(spark, sf_dir)
    return C.health_score(C.affected(masks), masks.agg(F.count("*").alias("pages")))


_ACCESS = "CASE WHEN {0} % 5 = 0 THEN NULL ELSE {0} % 3 <> 0 END"


@query("po5", "WITH b AS (SELECT * FROM (VALUES " + ", ".join(f"('{b[0]}', '{b[1]}', {i})" for i, b in enumerate(BOTS)) + f""") t(token, purpose, i)),
s AS (SELECT *, CASE WHEN token = 'GPTBot' THEN 'allow' WHEN token = 'Bingbot' THEN 'block' WHEN purpose IN ('search', 'user_fetch') THEN 'allow' WHEN purpose = 'training' THEN 'block' ELSE 'any' END AS stance,
 {_ACCESS.format('i')} AS allowed, i % 4 = 1 AS turned_away FROM b),
n AS (SELECT *, CASE WHEN allowed IS NULL THEN 'unknown' WHEN NOT allowed THEN 'blocked' WHEN turned_away THEN 'firewall' ELSE 'allowed' END AS now FROM s)
SELECT purpose, stance, now, count(*) AS bots, count(*) FILTER ((stance = 'allow' AND now IN ('blocked', 'firewall')) OR (stance = 'block' AND now = 'allowed')) AS gaps FROM n GROUP BY ALL""")
def po5(spark, sf_dir):
    """Rules on bots by purpose, and what each bot may do now."""
    bots = bots_dim(spark)
    wanted = A.stances(spark, bots, {"training": "block"}, {"gptbot": "allow", "bingbot": "block"})
    access = spark.createDataFrame([(b[0], i) for i, b in enumerate(BOTS)], "token string, i int")
    access = access.select("token", F.expr(_ACCESS.format("i")).alias("allowed"), F.expr("i % 4 = 1").alias("turned_away"))
    return P.purpose_rules(bots.select("token", "purpose"), access, wanted)
