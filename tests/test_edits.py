"""Differences by lines and keys, suggested robots files and challenge pages against plain versions."""

from __future__ import annotations

import json

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.functions.challenges import Detector
from pagewright.functions.dims import BOTS
from pagewright.functions.lines import common_lines, line_diff
from pagewright.functions.robots import Verdicts, groups_of, rules_for
from pagewright.functions.robots_edit import Intent, content_signal, suggested
from pagewright.operators import access as A
from pagewright.operators import edits as E
from pagewright.plans import all_plans

LINES = st.lists(st.sampled_from(["a", "b", "c", "d", ""]), max_size=14)


def longest(a, b):
    """Length of a longest common subsequence, by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=500, deadline=None)
@given(LINES, LINES)
def test_line_differences(have, want):
    a, b = [x for x in have if x], [x for x in want if x]
    pairs = common_lines(a, b)
    assert len(pairs) == longest(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    diff = line_diff(have, want)
    assert [x for sign, x in diff if sign != "-"] == want
    assert [x for sign, x in diff if sign != "+" and x] == a
    # Beyond the number of pairs it is still a difference of the two.
    rough = line_diff(have, want, most_pairs=0)
    assert [x for sign, x in rough if sign != "-"] == want and [x for sign, x in rough if sign != "+" and x] == a


def test_long_files_differ_in_time():
    a = [f"line {i}" for i in range(40_000)]
    assert sum(s != " " for s, _ in line_diff(a, a[:20_000] + ["new"] + a[20_001:])) == 2
    same = ["Disallow:"] * 20_000
    assert [s for s, _ in line_diff(same + ["x"], ["y"] + same)].count(" ") <= 20_000


FILES = [
    None,
    "",
    "User-agent: *\nDisallow: /\n",
    "# head\nUser-agent: GPTBot\nUser-agent: Other\nDisallow: /\n\nUser-agent: *\nContent-Signal: search=no\nDisallow: /tmp\nSitemap: https://x/s.xml\n",
    "User-agent: GPTBot\nDisallow: /\nAllow: /open\n\nUser-agent: ClaudeBot\nDisallow: /\n",
    "Sitemap: a\nUser-agent: Googlebot\nDisallow: /\nContent-Signal: ai-train=yes\n",
]
INTENTS = [Intent(), Intent({"training": "block"}), Intent({"search": "allow", "training": "block"}, {"claudebot": "allow", "OwnBot": "block"}), Intent({"training": "allow", "user_fetch": "block"})]


def test_suggested_files_do_what_the_policy_wants():
    for text in FILES:
        for intent in INTENTS:
            new = suggested(text, intent)
            groups, old = groups_of(new), groups_of(text)
            assert suggested(new, intent).count("Content-Signal: search=") == 1 and content_signal(intent) in new
            for token, purpose, *_ in [*BOTS, ("OwnBot", None)]:
                stance = intent.of(token, purpose)
                rule = Verdicts(rules_for(groups, token)).rule("/some/page")
                before = Verdicts(rules_for(old, token)).rule("/some/page")
                named = any(token.lower() in g.agents and not all(r.pattern == "/" and not r.allow for r in g.rules) for g in old)
                if stance == "block" and not named:
                    assert rule is not None and not rule.allow, (text, token)
                if stance == "allow" and not named:
                    assert rule is None or rule.allow, (text, token)
                if stance == "any":
                    assert (rule is None or rule.allow) == (before is None or before.allow), (text, token)
            for line in (text or "").split("\n"):  # what is no agent, signal or blank is kept
                if line.strip() and not line.lower().startswith(("user-agent", "content-signal")) and "Disallow: /" != line.strip():
                    assert line.strip() in new.split("\n")


def test_suggested_file_by_hand():
    assert suggested(FILES[3], INTENTS[1]) == (
        "# head\n\nUser-agent: Other\nDisallow: /\n\nUser-agent: *\nContent-Signal: search=yes, ai-input=yes, ai-train=no\nDisallow: /tmp\n\n"
        + "".join(f"User-agent: {b[0]}\n" for b in BOTS if b[1] == "training")
        + "Disallow: /\n\nSitemap: https://x/s.xml\n"
    )
    assert suggested(None, Intent()) == "User-agent: *\nContent-Signal: search=yes, ai-input=yes, ai-train=yes\nAllow: /\n"


def test_suggestions_and_differences_of_tables(spark):
    files = spark.createDataFrame(list(enumerate(FILES)), "site long, body string")
    rows = {r.site: r for r in E.suggestions(files, ["site"], INTENTS[1]).collect()}
    assert {k: r.suggested for k, r in rows.items()} == {k: suggested(t, INTENTS[1]) for k, t in enumerate(FILES)}
    assert rows[0].removed == 0 and rows[0].added == rows[0].suggested.strip().count("\n") + 1 - rows[0].suggested.strip().count("\n\n")
    pairs = files.join(files.selectExpr("site - 1 AS site", "body AS after"), "site", "left")
    got = {}
    for r in E.line_diffs(pairs, ["site"], "body", "after").orderBy("site", "place").collect():
        got.setdefault(r.site, []).append((r.sign, r.line))
    strip = lambda t: [x.strip() for x in t.split("\n")] if t else []
    assert got == {k: d for k, t in enumerate(FILES) if (d := line_diff(strip(t), strip(FILES[k + 1] if k + 1 < len(FILES) else None)))}
    assert E.line_diffs(pairs.limit(0), ["site"], "body", "after").count() == 0


def walk(path, a, b, absent):
    """Changed paths by plain recursion."""
    inside = [x for x in (a, b) if isinstance(x, dict)]
    if inside and all(isinstance(x, dict) or x is absent for x in (a, b)):
        members = [x if isinstance(x, dict) else {} for x in (a, b)]
        return [c for k in sorted({*members[0], *members[1]}) for c in walk(f"{path}.{k}".lstrip("."), members[0].get(k, absent), members[1].get(k, absent), absent)]
    text = lambda v: None if v is absent else json.dumps(v, separators=(",", ":"), sort_keys=True)
    return [(path, text(a), text(b))] if text(a) != text(b) else []


def test_changed_keys(spark):
    absent = object()
    texts = [
        ('{"a":1,"b":{"c":null,"d":{"e":"x"}},"f":[1,{"z":2}]}', '{"a":1,"b":{"d":{"e":"y","z":{}},"q":{"r":{"s":2}}},"f":[1,{"z":3}]}'),
        ('{"a":{"b":1}}', '{"a":3}'), (None, '{"k":{"m":1}}'), ("no json {", "{}"), ("[1]", "[1]"), ("3", '{"a":1}'), ('{"a":{}}', "{}"), ('{"x":null}', "{}"),
        ('{"x":null}', '{"x":"null"}'), ("null", None), (None, None), ('{"a":{"b":{"c":{"d":{"e":1}}}}}', '{"a":{"b":{"c":{"d":{"e":true}}}}}'),
    ]

    def read(t):
        try:
            return json.loads(t) if t is not None else absent
        except ValueError:
            return absent

    rows = [(k, *t) for k, t in enumerate(texts)]
    got = E.changed_keys(spark.createDataFrame(rows, "id long, old string, new string"), ["id"], "old", "new").collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted([(k, *c) for k, a, b in rows for c in walk("", read(a), read(b), absent)], key=key)
    assert E.changed_keys(spark.createDataFrame(rows, "id long, old string, new string").limit(0), ["id"], "old", "new").count() == 0


def test_challenges(spark):
    wide = b"x" * 70_000
    answers = [
        (1, 200, {"CF-Mitigated": " Challenge"}, b"", ("cloudflare", "cf-mitigated: challenge")),
        (2, 200, {"x-datadome": "1"}, b"", None), (3, 403, {"x-datadome": "1"}, b"", ("datadome", "x-datadome")),
        (4, 403, {"Server": "AkamaiGHost"}, b"<h1>Access Denied</h1> Reference&#32;&#35;18", ("akamai", "AkamaiGHost: Access Denied")),
        (5, 200, {}, b"press & HOLD px-captcha", ("human", "px-captcha")), (6, 200, {}, wide + b"_pxCaptcha", None), (7, 200, {}, b"_pxCaptcha" + wide, ("human", "_pxCaptcha")),
        (8, 200, {}, b"g-recaptcha", ("generic", "g-recaptcha")), (9, 200, {}, b"g-recaptcha" + wide, None), (10, None, None, None, None),
        (11, 200, {"a": None}, b"<TITLE a>Solve the CAPTCHA</title>", ("generic", "<title> captcha")), (12, 200, {}, b"\xff\xfe", None),
    ]
    detector = Detector()
    assert [detector.found(s, (h or {}).items(), b) for _, s, h, b, _ in answers] == [want for *_, want in answers]
    frame = spark.createDataFrame([a[:4] for a in answers], "page_id long, status int, headers map<string,string>, body binary")
    got = A.challenges(frame, "page_id", "status", "headers", "body").collect()
    assert {(r.page_id, (r.vendor, r.signal)) for r in got} == {(a[0], a[4]) for a in answers if a[4]}


def test_challenges_in_whole_bodies(spark, tmp_path):
    """x18 against its SQL over bodies around and far beyond 64 KiB, small ones and absent ones; markers stand before or after."""
    wide = ["x" * n for n in (65_520, 65_536, 70_000, 300_000, 10)]
    pages = [(62 * k + i, f"https://a.b/{62 * k + i}", html) for k, html in enumerate([*wide, None]) for i in range(62)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    wanted = con.execute(all_plans.ORACLE["x18"]).fetchall()
    got = all_plans.QUERIES["x18"](spark, str(tmp_path)).select("page_id", "vendor", "signal").collect()
    assert sorted(map(tuple, got)) == sorted(wanted)
    late = [i for i, _, html in pages if i % 31 == 2 and i % 13 > 5 and html and len(html) > 65_536]
    assert late and {(i, "cloudflare", "_cf_chl_opt") for i in late} <= set(wanted)


def test_changed_keys_move_no_rows(spark):
    """Levels are taken down where the documents lie: nothing in the plan is exchanged, and each level has a scan and no join."""
    rows = spark.range(50).selectExpr("id", """concat('{"a":{"b":', id, ',"c":{"d":1}},"e":', id % 2, '}') AS old""", """concat('{"a":{"b":', id % 7, '},"e":0}') AS new""")
    seen = []

    def cut(df):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df)

    real, E.cut_lineage = E.cut_lineage, cut
    try:
        got = E.changed_keys(rows, ["id"], "old", "new")
    finally:
        E.cut_lineage = real
    assert len(seen) == 4 and not any("Join" in p for p in seen)
    assert sorted((r.id, r.path) for r in got.collect()) == sorted([*((i, "a.b") for i in range(7, 50)), *((i, "a.c.d") for i in range(50)), *((i, "e") for i in range(1, 50, 2))])
