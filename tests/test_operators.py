"""Operators on small literal tables."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.functions import extract as E
from pagewright.functions.dims import BITS, CHECKS
from pagewright.operators import access as A
from pagewright.operators import checks as C
from pagewright.operators import explore as X
from pagewright.operators import graph as G
from pagewright.operators import robots as R
from pagewright.streaming import state as S


def test_registry_is_whole():
    assert [c[0] for c in CHECKS] == list(range(49)) and len(BITS) == 49


@pytest.mark.parametrize(("slug", "affected", "pages", "score"), [("http_5xx", 1, 1000, 96), ("sitemap_missing", 1, 10, 99), ("robots_blocks_site", 1, 10, 85), (None, 0, 5, 100)])
def test_health_score_golden(spark, slug, affected, pages, score):
    dim = C.checks_dim(spark)
    counts = dim.where(F.col("slug") == slug).withColumn("affected", F.lit(affected).cast("long")) if slug else dim.limit(0).withColumn("affected", F.lit(0).cast("long"))
    one = spark.createDataFrame([(pages,)], "pages long")
    assert C.health_score(counts, one).first().health_score == score


GEO = [("robots_unavailable", 70, 15), ("bots_blocked", 70, 15), ("answers_restricted", 70, 15), ("bots_not_blocked", 70, 5), ("fetch_blocked", 70, 5), ("content_missing", 70, 5)]
GEO += [("jsonld_invalid", 30, 5), ("title_missing", 30, 5), ("description_missing", 30, 5), ("sitemap", 30, 5), ("llms_txt", 30, 1), ("content_signals", 30, 1), ("markdown_negotiation", 30, 1)]


@pytest.mark.parametrize(("outcomes", "score"), [([], 100), ([("bots_blocked", 15, 0.5, False)], 89), ([("title_missing", 5, 1.0, False)], 93), ([("llms_txt", 1, 1.0, False)], 99), ([(n, 15, 1.0, False) for n, _, _ in GEO], 0)])
def test_geo_score_golden(spark, outcomes, score):
    found = spark.createDataFrame(outcomes, "name string, cap int, share double, skipped boolean")
    assert A.geo_score(spark.createDataFrame(GEO, "name string, tier int, weight int"), found).first().geo_score == score


def test_directive_scopes(spark):
    rows = [("noindex, nofollow", ["noindex", "nofollow"]), ("googlebot: noindex, nofollow, otherbot: none", ["noindex", "nofollow"]), ("otherbot: noindex", []), ("max-snippet:0, ALL", ["max-snippet:0", "all"]), (None, [])]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(rows)], "i int, v string")
    got = {r.i: r.d for r in df.select("i", A.directives(F.col("v"), ["googlebot"]).alias("d")).collect()}
    assert [got[i] for i in range(len(rows))] == [w for _, w in rows]


def test_robots_verdicts(spark):
    lines = ["User-agent: a", "User-agent: B", "Disallow: /x*y$", "Allow: /", "", "user-agent: *", "Disallow: /p # c", "Allow: /p/q", "Disallow:"]
    rules = R.parsed(spark.createDataFrame([("\n".join(lines),)], "body string"), [])
    paths = spark.createDataFrame(enumerate(["/x1y", "/x1yz", "/p", "/p/q/r", "/robots.txt", "/z"]), "page_id long, path string")
    got = {(r.page_id, r.token): (r.allowed, r.line) for r in R.verdicts(paths, ["b", "other"], rules).collect()}
    assert got[0, "b"] == (False, 3) and got[1, "b"] == (True, 4)
    assert got[2, "other"] == (False, 7) and got[3, "other"] == (True, 8) and got[4, "other"] == (True, None) and got[5, "other"] == (True, None)


def test_redirects_that_do_not_end(spark):
    chain = [(k, f"c{k}", f"c{k + 1}", 301) for k in range(13)] + [(13, "c13", None, 200)]
    loops = [(20, "a", "b", 301), (21, "b", "c", 302), (22, "c", "b", 301), (23, "self", "self", 301), (24, "out", "gone", 301)]
    pages = spark.createDataFrame(chain + loops, "page_id long, url string, redirect_target string, status int")
    got = {r.page_id: (r.final_url, r.final_status, r.hops, r.error) for r in G.redirect_ends(pages).collect()}
    assert got == {
        **{k: ("c13", 200, 13 - k, None) for k in range(3, 13)}, **{k: (None, None, 10, "too_many") for k in range(3)},
        20: (None, None, 3, "loop"), 21: (None, None, 2, "loop"), 22: (None, None, 2, "loop"), 23: (None, None, 1, "loop"), 24: ("gone", None, 1, None),
    }
    assert {r.page_id for r in G.final_target(pages).collect()} == {24, *range(3, 13)}


def test_click_depth_parents_and_redirects(spark):
    edges = spark.createDataFrame([(0, 1, 1, False), (0, 2, 2, False), (2, 3, 3, False), (1, 3, 4, False), (3, 0, 5, False), (0, 4, 6, True), (3, 5, 7, False)], "from_id long, to_id long, edge_seq long, nofollow boolean")
    depth = G.click_depth(edges, 0)
    assert {r.page_id: r.depth for r in depth.collect()} == {0: 0, 1: 1, 2: 1, 3: 2, 5: 3}
    assert {r.page_id: r.parent_id for r in G.tree_parents(depth, edges).collect()} == {1: 0, 2: 0, 3: 2, 5: 3}
    pages = spark.createDataFrame([(0, "a", 301, "b", None), (1, "b", 301, "c", None), (2, "c", 200, None, None), (3, "d", 301, "d", None), (4, "e", 301, "gone", None)], "page_id long, url string, status int, redirect_target string, error string")
    assert {(r.page_id, r.final_url, r.final_status, r.hops) for r in G.final_target(pages).collect()} == {(0, "c", 200, 2), (1, "c", 200, 1), (4, "gone", None, 1)}


def test_policy_reads_every_page_and_caps_links(spark, tmp_path):
    from pagewright.plans import all_plans

    n = 21_500
    spark.range(n).selectExpr("id AS page_id", "concat('https://e.com/p/', id) AS url", "'<title>t</title><article>x</article>' AS html").write.parquet(f"{tmp_path}/pages.parquet")
    rows = all_plans.QUERIES["src6"](spark, str(tmp_path)).select("page_id").toPandas().page_id
    assert list(rows) == [i for i in range(n) if i == 0 or i % 23]
    pages = spark.createDataFrame([(0, 200), (1, 301), (2, 308)], "page_id long, status int")
    edges = spark.createDataFrame([(5, i % 3, 100 - i) for i in range(30)], "from_id long, to_id long, edge_seq long")
    for most, capped in ((7, True), (20, True), (21, False)):
        got = G.redirect_inlinks(pages, edges, most).collect()
        assert {(r.edge_seq, r.to_id) for r in got} == set(sorted((100 - i, i % 3) for i in range(30) if i % 3)[:most]) and {r.inlinks_capped for r in got} == {capped}


def test_deep_chains_are_followed_to_their_end(spark):
    links = spark.createDataFrame([(i, i + 1, i, False) for i in range(53)], "from_id long, to_id long, edge_seq long, nofollow boolean")
    assert {r.page_id: r.depth for r in G.click_depth(links, 0).collect()} == {i: i for i in range(54)}
    parents = spark.createDataFrame([(i + 1, i) for i in range(18)], "page_id long, parent_id long")
    assert {r.page_id: r.above for r in G.nearest_above(parents, F.col("at") == 0).collect()} == dict.fromkeys(range(1, 19), 0)


@pytest.mark.parametrize(("most", "chain"), [(100, 0), (22, 14), (9, 20)])
def test_kept_pages_against_greedy(spark, most, chain):
    rng = np.random.default_rng(most)
    n = 40
    # A chain from the root at first, then a random tree; the last few pages hang nowhere. Ids are not in tree order.
    ids = [0, *(int(i) for i in rng.permutation(np.arange(1, n)))]
    parent = {ids[i]: ids[i - 1] if i <= chain else ids[int(rng.integers(0, i))] for i in range(1, n - 3)}
    score = {i: int(rng.integers(1, 12)) for i in range(n)}
    if chain:
        score[ids[chain]] = 99
    kept = set()
    for i in [0, *sorted(range(n), key=lambda i: (-score[i], i))]:
        new, at = [], i
        while at is not None and at not in kept:
            new.append(at)
            at = parent.get(at)
        if len(kept) + len(new) <= most:
            kept |= set(new)
    scores = spark.createDataFrame(list(score.items()), "page_id long, score int")
    got = [r.page_id for r in G.kept_pages(scores, spark.createDataFrame(list(parent.items()), "page_id long, parent_id long"), 0, most).collect()]
    assert len(got) == len(set(got)) and set(got) == kept and len(kept) == min(n, most)


def test_link_score_against_numpy(spark):
    rng = np.random.default_rng(2)
    n, pairs = 25, {(int(a), int(b)) for a, b in rng.integers(0, 25, (60, 2))}
    edges = spark.createDataFrame([(a, b, i, False) for i, (a, b) in enumerate(sorted(pairs))], "from_id long, to_id long, edge_seq long, nofollow boolean")
    got = {r.page_id: r for r in G.link_score(spark.range(n).withColumnRenamed("id", "page_id"), edges).collect()}
    m = np.zeros((n, n))
    for a, b in pairs:
        if a != b:
            m[b, a] = 1
    out = m.sum(axis=0)
    rank = np.full(n, 1 / n)
    for _ in range(30):
        rank = 0.15 / n + 0.85 * (m @ np.divide(rank, out, where=out > 0, out=np.zeros(n)) + rank[out == 0].sum() / n)
    assert all(abs(got[i].rank - rank[i]) < 1e-8 for i in range(n))
    low, high = np.log(rank).min(), np.log(rank).max()
    assert all(abs(got[i].score - (1 + 99 * (np.log(rank[i]) - low) / (high - low))) <= 1 for i in range(n))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abAB:/?#%.é -~7eF", max_size=40))
def test_normalised_url_is_idempotent(text):
    once = E.normalised_url("https://Example.com/dir/page", text)
    assert once is None or E.normalised_url("https://other.org/", once) == once


@pytest.mark.parametrize(("href", "want"), [("/x", "https://e.com/x"), ("?q=1", "https://e.com/d/p?q=1"), ("../y/./z", "https://e.com/y/z"), ("#a", None), ("mailto:a@b", None), ("//F.ORG:443/%7ea%2fb", "https://f.org/~a%2Fb"), ("https://e.com./", "https://e.com/")])
def test_normalised_url_cases(href, want):
    got = E.normalised_url("https://e.com/d/p", href)
    assert got == want or (got or "").replace("%2F", "/") == (want or "").replace("%2F", "/")


def test_extract_page():
    html = """<html><head><title> A &amp;
 B </title><title>two</title><meta name="Description" content="d"><meta property="og:title" content="o"><link rel="canonical" href="/c#x">
<script type="application/ld+json">{"a": 1}</script><script>var x = "<h1>no</h1>";</script></head><body><h1>One <b>big</b></h1><h2></h2><p>foo<i>bar</i>baz
<a href="/l?b=1" rel="x NoFollow">go <b>there</b></a><a href="mailto:x">m</a><img src=a><img src=b alt="">"""
    f = E.extract("https://e.com/", html)
    assert (f["title"], f["title_count"], f["h1"], f["h2"]) == ("A & B", 2, ["One big"], [])
    assert (f["description"], f["og_title"], f["canonical"], f["jsonld"], f["images_missing_alt"]) == ("d", "o", "https://e.com/c", "valid", 1)
    assert f["links"] == [{"url": "https://e.com/l?b=1", "anchor": "go there", "nofollow": True}]
    assert f["word_count"] == len("One big foo barbaz go there m".split())
    assert E.extract(None, None)["word_count"] == 0 and E.extract("x", "<<a <!-- </") is not None


def test_sitemap_and_llms():
    kind, urls, dates = E.sitemap('<urlset xmlns="http://x"><url><loc> a </loc><lastmod>2024-01-02T00:00:00Z</lastmod></url><url><loc>b</loc></url><url/></urlset>')
    assert (kind, urls, dates) == ("urls", ["a", "b"], ["2024-01-02", None])
    assert E.sitemap("<bad")[0] == E.sitemap(None)[0] == "invalid"
    found = E.llms_sections("# T\n> S\n```\n## no\n```\n## Docs\n- [a](/a): x\n## Two\n[b](http://b) [c](c)")
    assert found == {"title": "T", "h1_first": True, "summary": "S", "sections": [{"name": "Docs", "links": ["/a"]}, {"name": "Two", "links": ["http://b", "c"]}]}


def test_filters_and_globs(spark):
    df = spark.createDataFrame([("/a/b.html", "x=1"), ("/a/", ""), ("/B", "")], "path string, query string")
    got = lambda p, **k: [r.m for r in df.select(X.glob_match(F.col("path"), F.col("query"), p, **k).alias("m")).collect()]
    assert got("/a/*") == [True, True, False] and got("/a/*?x=*") == [True, False, False] and got("/b", ignore_case=True) == [False, False, True] and got("/a.*") == [False] * 3
    assert X.like_literal("50%_\\") == "50\\%\\_\\\\"


@given(st.lists(st.integers(0, 300), max_size=60), st.integers(1, 5))
def test_admission_is_a_fold(times, cut):
    times = sorted(times)
    whole, _ = S.admitted_calls(times, [], 3, 60)
    half = len(times) * cut // 6
    first, held = S.admitted_calls(times[:half], [], 3, 60)
    second, _ = S.admitted_calls(times[half:], held, 3, 60)
    assert first + second == whole
    taken = [t for t, ok in zip(times, whole) if ok]
    assert all(sum(t - 60 < x <= t for x in taken) <= 3 for t in taken)


def test_incident_steps():
    state, steps = S.incident_step(None, [(1, 2), (2, 2), (3, 1), (4, None), (5, None), (6, 2)])
    assert steps == [(1, "opened"), (3, "escalated"), (4, "resolved"), (6, "opened")] and state["open"]


def test_streams_equal_batches(spark, sf_dir):
    from pagewright.plans import all_plans

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type").toPandas()
    got = {r.event_id: r.accepted for r in all_plans.QUERIES["s3"](spark, sf_dir).collect()}
    for _, calls in events.sort_values(["ts", "event_id"]).groupby("user_id"):
        at = calls.ts.astype("datetime64[us]").astype("int64").tolist()
        ok, _ = S.admitted_calls(at, [], 2, 6 * 3600 * 1_000_000)
        assert [got[i] for i in calls.event_id] == ok
    kinds = all_plans.QUERIES["s15"](spark, sf_dir).groupBy("step").count().collect()
    assert {r.step for r in kinds} <= {"opened", "escalated", "resolved", "lapsed"}


def test_thresholds_only_move_their_checks(spark, sf_dir):
    from pagewright.plans.fixtures import edges, narrow

    pages, links = narrow(spark, sf_dir), edges(spark, sf_dir)
    base, strict = C.issues(pages, links), C.issues(pages, links, C.Thresholds(title_long=1, thin_words=10**6, slow_ms=0))
    moved = sum(1 << BITS[s] for s in ("title_too_long", "thin_content", "slow_response"))
    both = base.join(strict.withColumnRenamed("issues", "s"), "page_id")
    assert both.where(F.col("issues").bitwiseAND(F.lit(~moved)) != F.col("s").bitwiseAND(F.lit(~moved))).count() == 0
    assert both.where(F.col("issues").bitwiseAND(F.lit(moved)).bitwiseAND(F.bitwise_not("s")) != 0).count() == 0
