"""Readers, writers, schedules and small parsers: the cases that the test tables do not hold."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from pagewright.functions import extract as E
from pagewright.operators import geo as G
from pagewright.operators import policy as P
from pagewright.operators import robots as R
from pagewright.operators.explore import scheduled
from pagewright.sources import readers, writers


def urlset(*urls):
    return "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"


def index(*files):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{f}</loc></sitemap>" for f in files) + "</sitemapindex>"


def test_sitemaps_are_followed_two_deep(spark):
    files = [("/r", index("/a", "/i", "/r", "/gone")), ("/i", index("/b", "/j")), ("/j", index("/c")), ("/a", urlset("u1", "u2")), ("/b", urlset("u2", "u3")), ("/c", urlset("u4")), ("/broken", "<urlset>")]
    files = spark.createDataFrame(files, "file string, xml string")
    roots = spark.createDataFrame([("s", "/r"), ("t", "/broken"), ("t", "/c")], "site string, file string")
    found = readers.sitemap_files(files, roots)
    assert {(r.site, r.file, r.depth) for r in found.collect()} == {("s", "/r", 0), ("s", "/a", 1), ("s", "/i", 1), ("s", "/b", 2), ("s", "/j", 2), ("t", "/broken", 0), ("t", "/c", 0)}
    assert {(r.site, r.url, r.file) for r in readers.sitemap_urls(found).collect()} == {("s", "u1", "/a"), ("s", "u2", "/a"), ("s", "u3", "/b"), ("t", "u4", "/c")}
    assert readers.sitemap_files(files, roots, most_files=2).count() == 4
    assert readers.sitemap_files(files.limit(0), roots).count() == 0


def test_set_hash_does_not_follow_order(spark):
    rows = [("a", u) for u in "xyz"] + [("b", u) for u in "zyxx"] + [("c", u) for u in "xy"]
    got = {r.s: (r.urls, r.hash) for r in readers.set_hash(spark.createDataFrame(rows, "s string, url string"), ["s"]).collect()}
    assert got["a"] == got["b"] != got["c"]


def test_policy_files():
    policy, unknown = readers.policy_file('[address]\nslash = "with"\n[must_work]\nurls = ["https://a.b/"]\nsecret = 1\n[other]\n')
    assert policy.slash == "with" and policy.must_work == ("https://a.b/",) and unknown == ["must_work.secret", "other"]
    with pytest.raises(ValueError):
        readers.policy_file("[address")


def test_audits_of_other_versions(spark, tmp_path):
    lines = ['{"format_version": 2, "crawl_id": 1, "site": "s", "counts": [{"check": "noindex", "affected": 2}, {"check": "new_one", "affected": 1}]}', '{"format_version": 3, "shape": 1}', "no json"]
    (tmp_path / "a.json").write_text("\n".join(lines))
    rows = readers.audits(spark, str(tmp_path)).collect()
    assert [(r.crawl_id, [c.check for c in r.counts]) for r in rows] == [(1, ["noindex"])]
    assert {r.format_version: r.n for r in readers.rejected_audits(spark, str(tmp_path)).collect()} == {3: 1, None: 1}


def test_written_crawls_replace_their_own(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 3, "c")], "site_id long, crawl_id long, url string")
    writers.write_crawls(rows, f"{tmp_path}/w")
    writers.write_crawls(rows.where("crawl_id = 2").withColumn("url", F.lit("z")), f"{tmp_path}/w")
    assert {(r.crawl_id, r.url) for r in spark.read.parquet(f"{tmp_path}/w").collect()} == {(1, "a"), (2, "z"), (3, "c")}


def test_report_lines(spark):
    row = spark.createDataFrame([('a,"b"', "100%|x\ny")], "p string, q string")
    got = row.select(writers.csv_line(F.col("p"), F.col("q")).alias("c"), writers.markdown_line(F.col("q")).alias("m"), writers.annotation_line(F.lit("critical"), F.lit("a:b,c"), F.col("q")).alias("n")).first()
    assert got.c == '"a,""b""","100%|x\ny"' and got.m == "| 100%\\|x\ny |" and got.n == "::error title=a%3Ab%2Cc::100%25|x%0Ay"


def test_daily_slots_follow_the_zone(spark):
    """The hour that clocks skip becomes the next one; slots are strictly after."""
    cases = [("2024-03-30 12:00:00", 2, "Europe/Berlin", "2024-03-31 01:00:00"), ("2024-01-10 05:00:00", 6, "Europe/Berlin", "2024-01-11 05:00:00"), ("2024-01-10 04:59:59", 6, "Europe/Berlin", "2024-01-10 05:00:00")]
    rows = spark.createDataFrame(cases, "t string, hour int, zone string, want string").withColumn("t", F.col("t").cast("timestamp"))
    for r in scheduled(rows, F.lit(0), F.col("hour"), F.col("zone"), F.col("t")).collect():
        assert str(r.daily) == r.want, r
        assert r.weekly > r.t and r.weekly.weekday() == 0 and r.weekly.time() == datetime.time(0) and r.weekly - r.t <= datetime.timedelta(days=7)


def test_link_headers():
    assert E.link_header_alternate('</a>; rel="next", </b.md>; rel="x Alternate"; type="text/markdown; v=1"') == "/b.md"
    assert E.link_header_alternate("</a>; rel=alternate; type=text/html") is None and E.link_header_alternate(None) is None and E.link_header_alternate("<broken") is None


def test_parts_of_unclosed_pages():
    html = '<div id=root><p>text<main>one two <span data-nosnippet>three</main> four <noscript>Please <b>turn  on</b> JavaScript</noscript><script type=module src=x></script><link rel=modulepreload href=y>'
    got = E.extract("https://a.b/", html)
    assert (got["mount"], got["mount_empty"], got["main_words"], got["nosnippet_words"], got["external_scripts"], got["script_notice"]) == ("root", False, 3, 1, 2, True)


def test_robots_of_several_hosts(spark):
    files = [("h1", "User-agent: *\nDisallow: /a"), ("h2", "User-agent: b\nDisallow: /*.x$\nAllow: /a.x"), ("h4", None), ("h5", "")]
    rules = R.parsed(spark.createDataFrame(files, "file string, body string"), ["file"])
    paths = spark.createDataFrame([(1, "/a.x", "h1"), (2, "/a.x", "h2"), (3, "/b.x", "h2"), (4, "/b.xy", "h2"), (5, "/a", "h3")], "page_id long, path string, file string")
    got = {(r.page_id, r.token): (r.allowed, r.line) for r in R.verdicts(paths, ["b", "c"], rules, by=["file"]).collect()}
    assert got == {(1, "b"): (False, 2), (1, "c"): (False, 2), (2, "b"): (False, 2), (2, "c"): (True, None), (3, "b"): (False, 2), (3, "c"): (True, None), (4, "b"): (True, None), (4, "c"): (True, None), (5, "b"): (True, None), (5, "c"): (True, None)}


def test_addresses_of_a_policy(spark):
    policy = P.Policy("https", "a.b", "with", ignore_params=("utm_*", "REF"), pagination_param="page")
    urls = ["http://a.b/x/", "https://www.a.b/x/", "https://a.b/x", "https://a.b/x/", "https://a.b/", "https://a.b/f.xml", "https://A.b/x/?ref=1&page=2&UTM_a=3&ref=4"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(P.off_address(F.col("u"), policy).alias("off"), P.ignored_params(F.col("u"), policy).alias("p")).collect()
    assert [r.off for r in rows] == ["scheme", "host", "slash", None, None, None, None] and rows[-1].p == ["ref", "UTM_a"]


def test_gates_count_what_is_new(spark):
    counts = spark.createDataFrame([("noindex", "notice", 5), ("http_4xx", "critical", 2)], "slug string, severity string, affected long")
    findings = spark.createDataFrame([("k", "s1", "warning"), ("k", "s2", "warning"), ("q", "", "notice")], "kind string, subject string, severity string")
    gaps = spark.createDataFrame([("r", "s1", "critical")], "rule string, subject string, severity string")
    seen = spark.createDataFrame([("finding:k", "s1")], "rule string, subject string")
    got = {(r.rule, r.n) for r in G.gate(counts, findings, gaps, seen, ["critical", "warning"]).collect()}
    assert got == {("http_4xx", 2), ("finding:k", 1), ("policy:r", 1)}
    assert {r.rule for r in G.gate(counts, findings, gaps, seen, ["notice"]).collect()} == {"noindex", "http_4xx", "finding:k", "finding:q", "policy:r"}
