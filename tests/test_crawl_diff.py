"""Differences of two crawls: moves, early stops, key pages, spikes, robots files, sitemaps; each test states its cases by hand."""

from __future__ import annotations

import pytest

from pagewright.operators import crawl_diff as D

PAGE = "site_id string, url string, status int, error string, indexability string, title string, canonical string, hops int, inlinks int"
SITE = "site_id string, origin string, stop string, robots_status int, robots_print string, sitemap_urls long, sitemap_whole boolean"


def page(url, status=200, title="T", site="s", error=None, state="indexable", canonical=None, hops=0, inlinks=0):
    return (site, url, status, error, state, title, canonical, hops, inlinks)


def site(origin, stop="completed", site="s", robots=200, rules="r", urls=10, whole=True):
    return (site, origin, stop, robots, rules, urls, whole)


@pytest.fixture
def diff(spark):
    def run(before, after, starred=()):
        snap = lambda s: (spark.createDataFrame(s[0], SITE), spark.createDataFrame(s[1], PAGE))
        rows = D.crawl_changes(snap(before), snap(after), spark.createDataFrame(list(starred), "site_id string, url string")).collect()
        return sorted((r.site_id, r.kind, r.severity, r.url, r.before, r.after) for r in rows)

    return run


def one_site(origin, *paths, **more):
    return [site(origin, **more)], [page(origin + p) for p in paths]


def sides(cases):
    """Each case as a site of its own, so that one run holds them all."""
    named = lambda k, side: ([(k, *c[1:]) for c in side[0]], [(k, *p[1:]) for p in side[1]])
    both = [(named(k, b), named(k, a)) for k, (b, a) in cases.items()]
    return tuple(([c for x in both for c in x[i][0]], [p for x in both for p in x[i][1]]) for i in (0, 1))


def test_a_move_is_one_change(diff):
    to = ["https://e.com/", "http://www.e.com/", "http://e.com:8443/"]
    cases = {t: (one_site("http://e.com/", "", "a", "b?x=1"), one_site(t, "", "a", "b?x=1")) for t in to}
    assert diff(*sides(cases)) == sorted((t, "site_moved", "critical", None, "http://e.com/", t) for t in to)


def test_usual_ports_and_capitals_are_no_move(diff):
    assert diff(([site("https://E.com:443/")], [page("https://e.com/a")]), ([site("https://e.com/")], [page("https://e.com/a")])) == []


def test_canonicals_move_along_and_real_changes_stay(diff):
    before = [site("https://e.com/")], [page("https://e.com/"), page("https://e.com/a", canonical="https://e.com/a"), page("https://e.com/b", canonical="https://other.com/b")]
    after = [site("https://w.e.com/")], [page("https://w.e.com/"), page("https://w.e.com/a", title="New", canonical="https://w.e.com/a"), page("https://w.e.com/b", canonical="https://other.com/b"), page("https://w.e.com/c")]
    # All four are key pages by their links, so a notice is a warning.
    assert diff(before, after) == sorted([
        ("s", "site_moved", "critical", None, "https://e.com/", "https://w.e.com/"),
        ("s", "title_changed", "warning", "https://w.e.com/a", "T", "New"),
        ("s", "new_url", "warning", "https://w.e.com/c", "", "200"),
    ])


def many(n, stop="completed", failing=0, site_id="s"):
    rows = [page(f"https://e.com/p{i:02d}", 404 if i < failing else 200, site=site_id, state="client_error" if i < failing else "indexable", inlinks=100 - i) for i in range(n)]
    return [site("https://e.com/", stop, site=site_id)], rows


def test_an_early_stop_says_nothing_of_what_it_missed(diff):
    assert diff(many(50), many(10, "page_limit")) == [] == diff(many(10, "page_limit"), many(50))
    rows = diff(many(50), many(10))
    assert len(rows) == 40 and {r[1] for r in rows} == {"removed_url"} and {r[2] for r in rows} == {"notice"}


def test_key_pages_weigh_more(diff):
    rows = diff(many(30), many(25), [("s", "https://e.com/p29"), ("t", "https://e.com/p28")])
    assert {r[3][-2:]: r[2] for r in rows} == {"25": "notice", "26": "notice", "27": "notice", "28": "notice", "29": "warning"}
    rows = diff(many(30), many(30, failing=30))
    assert {r[3][-2:]: r[2] for r in rows if r[1] == "status_changed"} == {f"{i:02d}": "critical" if i < 20 else "warning" for i in range(30)}


def test_spikes_count_what_fails_anew(diff):
    new = many(30)[0], many(30)[1] + [page(f"https://e.com/n{i}", 0, error="timeout", state="server_error") for i in range(3)]
    kept_out = many(30)[0], many(30)[1] + [page(f"https://e.com/n{i}", 0, state="blocked_by_robots") for i in range(3)]
    cases = {
        "two": (many(30), many(30, failing=2)), "three": (many(30), many(30, failing=3)), "again": (many(30, failing=3), many(30, failing=3)),
        "three of 151": (many(151), many(151, failing=3)), "four of 151": (many(151), many(151, failing=4)),
        "new": (many(30), new), "new to a part": (many(30, "page_limit"), new), "kept out": (many(30), kept_out),
    }
    got = {r[0]: (r[2], *r[4:]) for r in diff(*sides(cases)) if r[1] == "error_spike"}
    assert got == {"three": ("critical", "0", "3"), "four of 151": ("critical", "0", "4"), "new": ("critical", "0", "3")}


def test_pages_by_field(diff):
    other = [page(f"https://e.com/x{i:02d}", inlinks=9) for i in range(20)]
    before = [page("https://e.com/a", title=" Old "), page("https://e.com/b", title="Old"), page("https://e.com/c", state="redirected", hops=1), page("https://e.com/d", title=None), page("https://e.com/e", canonical="https://e.com/q")]
    after = [page("https://e.com/a", title="Old"), page("https://e.com/b", title="  "), page("https://e.com/c", state="noindex", hops=2), page("https://e.com/d", title="New"), page("https://e.com/e")]
    assert diff(([site("https://e.com/")], before + other), ([site("https://e.com/")], after + other)) == sorted([
        ("s", "title_removed", "warning", "https://e.com/b", "Old", ""),
        ("s", "redirect_chain_grew", "notice", "https://e.com/c", "1", "2"),
        ("s", "became_noindex", "warning", "https://e.com/c", "Redirected", "Noindex"),
        ("s", "canonical_changed", "notice", "https://e.com/e", "https://e.com/q", "none"),
    ])


def test_robots_files(diff):
    cases = [
        ({"robots": None}, {"robots": None, "rules": "x"}, None),
        ({}, {"robots": 404}, ("warning", "200", "404")),
        ({"robots": None}, {}, ("warning", "none", "200")),
        ({}, {"rules": "x"}, ("warning", "200", "200 (rules changed)")),
        ({}, {"stop": "robots_blocked"}, ("critical", "200", "200 (blocks the crawl)")),
        ({}, {"stop": "robots_blocked", "rules": "x"}, ("critical", "200", "200 (rules changed, blocks the crawl)")),
        ({"stop": "robots_blocked"}, {"stop": "robots_blocked"}, None),
    ]
    made = {str(k): (one_site("https://e.com/", "", **b), one_site("https://e.com/", "", **a)) for k, (b, a, _) in enumerate(cases)}
    got = {r[0]: (r[2], *r[4:]) for r in diff(*sides(made)) if r[1] == "robots_txt_changed"}
    assert got == {str(k): want for k, (_, _, want) in enumerate(cases) if want}


def test_sitemaps(diff):
    cases = {"tenth": (10, 9, True), "less": (100, 91, True), "none": (0, 0, True), "part": (10, 1, False)}
    made = {k: (one_site("https://e.com/", "", urls=b, whole=w), one_site("https://e.com/", "", urls=a)) for k, (b, a, w) in cases.items()}
    assert diff(*sides(made)) == [("tenth", "sitemap_shrank", "warning", None, "10", "9")]


def test_odd_rows(diff, spark):
    """Pages off the origin, repeated ones, null addresses, sites of one side, empty tables."""
    before = [site("https://e.com/"), site("https://gone.com/", site="g")], [page("https://e.com/a"), page("https://e.com/a"), page("http://e.com/a", 404), page(None), ("s", "https://e.com/n", None, None, None, None, None, None, None)]
    after = [site("https://e.com/"), site("https://new.com/", site="n")], [page("https://e.com/a"), page("https://e.com:80/z"), page(None), ("s", "https://e.com/n", None, None, None, None, None, None, None)]
    assert diff(before, after) == []
    assert diff(([], []), ([], [])) == []
    rows = spark.createDataFrame([("s", "http://e.com/a"), ("s", "https://e.com/a"), ("s", "https://e.com:443/b"), ("t", "http://x:8080"), ("u", None)], "site_id string, url string")
    assert {tuple(r) for r in D.home_origins(rows).collect()} == {("s", "https://e.com/"), ("t", "http://x:8080/")}


def test_many_sites_do_not_mix(diff):
    before, after = many(12), many(12, failing=4, site_id="t")
    rows = diff((before[0] + many(12, site_id="t")[0], before[1] + many(12, site_id="t")[1]), (before[0] + after[0], before[1] + after[1]))
    assert {r[0] for r in rows} == {"t"} and sum(r[1] == "status_changed" for r in rows) == 4
