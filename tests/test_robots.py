"""Robots files: groups, patterns against regular expressions, hostile files, many paths of one file."""

from __future__ import annotations

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.functions.robots import MOST_BYTES, Pattern, Rule, Verdicts, groups_of, product_token, rules_for
from pagewright.operators import robots as R


@settings(max_examples=400, deadline=None)
@given(st.text("ab/*$", max_size=9).map(lambda p: p if p[:1] in ("/", "*") else "/" + p), st.text("ab/$*", max_size=14).map(lambda p: "/" + p))
def test_patterns_fit_as_regular_expressions_do(pattern, path):
    fixed = pattern.endswith("$")
    rx = ".*".join(map(re.escape, pattern.removesuffix("$").split("*"))) + (r"\Z" if fixed else "")
    assert Pattern(pattern).fits(path) == bool(re.match(rx, path))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("ab*$", max_size=4), st.booleans()), max_size=12), st.text("ab", max_size=5))
def test_index_finds_what_a_scan_finds(patterns, path):
    rules = [Rule(i, allow, "/" + p, len(p) + 1) for i, (p, allow) in enumerate(patterns)]
    fit = [r for r in rules if Pattern(r.pattern).fits("/" + path)]
    best = min(fit, key=lambda r: (-r.length, not r.allow, r.line), default=None)
    assert Verdicts(rules).rule("/" + path) == best


def test_groups():
    body = "\ufeffUser-Agent: A/2.0 (+x)\n# between\n\nSitemap: s\nuser-agent : b\r\nDisallow: x # c\nCrawl-delay: 1\nUser-agent: *\nDisallow:\nnot a line\nUser-agent: c\nAllow: /%2Ay%24\n"
    groups = groups_of(body)
    assert [g.agents for g in groups] == [["a", "b"], ["*"], ["c"]]
    assert [[tuple(r) for r in g.rules] for g in groups] == [[(6, False, "/x", 2)], [], [(12, True, "/%2Ay%24", 8)]]
    assert rules_for(groups, "Z") == [] and rules_for(groups, "Z", "B")[0].line == 6 and rules_for(groups, "C", "B")[0].line == 12
    assert Pattern("/%2Ay%24").fits("/*y$") and not Pattern("/%2ay").fits("/zy")
    assert groups_of(None) == groups_of(b"") == groups_of("Disallow: /before any group") == []
    assert product_token(" *x") == "*" and product_token("Bot-1_a/2") == "bot-1_a"
    assert groups_of("user-agent: a\nallow: /" + "x" * 1024)[0].rules == []
    assert groups_of(b"user-agent: a\nallow: /\xff")[0].rules[0].pattern == "/�"


@pytest.mark.parametrize(
    "body",
    [
        "User-agent: *\n" + "Disallow: /" + "*a" * 500 + "*b\n" + ("Disallow: /" + "*a" * 120 + "*b$\n") * 2000,
        "User-agent: *\n" + "".join(f"Disallow: /{'a' * (i % 900)}*{i}\n" for i in range(3000)),
        "".join(f"User-agent: bot{i}\nDisallow: /{i}\n" for i in range(21_000)),
    ],
)
def test_hostile_files_take_linear_time(body):
    began = time.time()
    groups = groups_of(body[: MOST_BYTES + 10])
    for token in ("bot7", "other"):
        judged = Verdicts(rules_for(groups, token))
        for k in range(100):
            judged.rule("/" + "a" * 2000 + str(k))
    assert time.time() - began < 4


def test_a_file_with_very_many_paths_is_dealt_into_slices(spark, monkeypatch):
    monkeypatch.setattr(R, "SLICE", 50)
    files = spark.createDataFrame([("hot", "User-agent: *\nDisallow: /*7$\nUser-agent: free\n"), ("cold", "User-agent: free\nDisallow: /")], "site string, body string")
    paths = [("hot", i, f"/{i}") for i in range(1000)] + [("cold", 1000, "/7"), ("none", 1001, "/7"), (None, 1002, "/7"), ("hot", 1003, None), ("hot", 7, "/7")]
    rules = R.parsed(files, ["site"])
    got = R.verdicts(spark.createDataFrame(paths, "site string, page_id long, path string").repartition(3), ["Any", "free"], rules, by=["site"]).collect()
    want = [(i, t, not (s == "hot" and t == "Any" and str(p).endswith("7")) and not (s == "cold" and t == "free")) for s, i, p in paths for t in ("Any", "free")]
    assert sorted((r.page_id, r.token, r.allowed) for r in got) == sorted(want)
    assert R.verdicts(spark.createDataFrame(paths, "site string, page_id long, path string").limit(0), ["Any"], rules, by=["site"]).count() == 0
