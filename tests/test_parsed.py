"""From answers to the page table: odd rows, links by address, depth, fields of pages that are no html."""

from __future__ import annotations

from pagewright.functions.extract import extract
from pagewright.operators import checks as C
from pagewright.operators.parsed import page_table

DDL = "page_id long, url string, html string, status int, error string, content_type string, response_ms int, hops int, redirect_target string, in_sitemap boolean"


def answer(i, url, html="", status=200, error=None, kind="text/html", more=()):
    return (i, url, html, status, error, kind, 10, 0, None, True, *more)


def test_pages_and_links(spark):
    rows = [
        answer(0, "https://a.b/", '<title> A  b</title><h1></h1><h1>H</h1><a href="/x">1</a><a href="x#f" rel=nofollow>2</a><a href=//c.d/>3</a><a href="/y">4</a><a href="https://a.b/">5</a>'),
        answer(1, "https://a.b/x", '<a href="/y">y</a><link rel=canonical href="/">'), answer(2, "https://a.b/x", "<meta name=robots content='nofollow, NOINDEX'>"),
        answer(3, "https://a.b/y", "<title>PDF</title>", kind="application/pdf"), answer(4, "https://a.b/z", "<title>Gone</title>", 404), answer(5, "https://a.b/n", None, kind=None),
        answer(6, "https://a.b/t", None, None, "timeout"), answer(7, "https://a.b/r", None, 0), answer(None, "https://a.b/q", "<a href=/z>"), answer(8, None, "<a href=/z>"),
    ]
    pages, links = page_table(spark.createDataFrame(rows, DDL), 0)
    got = {r.page_id: r for r in pages.collect()}
    assert sorted(got) == list(range(8))
    assert {i: r.indexability for i, r in got.items()} == {0: "indexable", 1: "canonicalised", 2: "noindex", 3: "indexable", 4: "client_error", 5: "indexable", 6: "server_error", 7: "blocked_by_robots"}
    assert {i: r.depth for i, r in got.items() if r.depth is not None} == {0: 0, 1: 1, 3: 1}
    assert (got[0].title, got[0].title_count, got[0].h1, got[0].h1_count, got[0].outlinks_internal, got[0].outlinks_nofollow, got[0].inlinks) == ("A b", 1, "H", 1, 2, 1, 0)
    assert (got[1].inlinks, got[2].inlinks, got[3].inlinks) == (1, 0, 2) and got[3].title is None and got[4].title is None and got[5].word_count == 0
    assert sorted((r.from_id, r.to_id, r.nofollow, r.anchor) for r in links.collect()) == [(0, 0, False, "5"), (0, 1, False, "1"), (0, 1, True, "2"), (0, 3, False, "4"), (1, 3, False, "y")]
    assert C.issues(pages, links).count() == 8


def test_empty_and_clashing_columns(spark):
    rows = spark.createDataFrame([answer(0, "https://a.b/", "<p>x", more=("f", 1))], f"{DDL}, fields string, depth int")
    pages, links = page_table(rows, 0)
    assert pages.first().depth == 0 and links.count() == 0
    none, links = page_table(rows.limit(0), 0)
    assert none.count() == 0 == links.count() and C.issues(none, links).count() == 0


def test_repeated_texts_and_plain_loads():
    same = [extract("https://a.b/", h)["content_key"] for h in ("<p>one <b>two", "<div>one\n<i>two</i></div>", "<title>t</title>one two")]
    assert len(set(same)) == 1 and extract("", "<p>two one")["content_key"] != same[0]
    html = "<img src='HTTP://x/a'><img src=//x/a><a href=http://x/><script src=http://x/></script><link rel='Stylesheet' href=http://x/><link rel=next href=http://x/>"
    assert extract("https://a.b/", html)["mixed_content"] == 3 and extract("http://a.b/", html)["mixed_content"] == 0


def test_addresses_in_one_form_are_as_if_joined():
    from pagewright.functions.extract import _joined, normalised_url

    bases = [None, "", "https://A.b:443/x/y?z", "http://u@a.b:8080", "http://[bad", "mailto:x", "//c.d/", "ftp://f/", "https://é.b/", "https://a.b/;p"]
    tails = ["", "/", "/a", "/a//b", "//c.d/e", "/a/", "/a;", "/a;b", "/./a", "/a/..", "/a.b/.c", "/a%20b", "/a?", "/a?b=c&d", "/a?b?#f", "/a#", "/a# f", "?q", "?", "x", "/é", "/a[b]", "/a'(b)*!$,~", "/a:b@c", "/_-.", "/a?é", "/a?b;c", "/a\tb", "/a\\b", "/A"]
    origins = ["", "https://a.b", "http://a.b", "http://a.b.", "http://a.b:80", "http://a.b:81", "HTTP://a.b", "http://A.b", "http://-", "http://", "https://a_b", "http://..", "http://a..b", "https://u:p@a.b", "ftp://a.b", "http://[::1]"]
    for base in bases:
        for href in (o + t for o in origins for t in tails):
            wanted = _joined(base, href) if href and not href.startswith("#") else None
            assert normalised_url(base, href) == wanted, (base, href)


def test_a_worker_holds_few_pages_at_a_time(monkeypatch):
    """Fields go on in pieces of the batch, whatever its size."""
    import pyarrow as pa

    from pagewright.functions import extract as E

    html = ["<p>x<a href=/y>y</a>"] * 700 + [None, "z" * (3 << 20), "<p>last", "w" * (1 << 20), "v"]
    columns = [pa.array(["https://a.b/"] * len(html)), pa.array(html), pa.array([i % 5 > 0 for i in range(len(html))]), pa.array(range(len(html)))]
    made = list(E._extracted(iter([pa.RecordBatch.from_arrays(columns, names=["_url", "_html", "_wanted", "page_id"])])))
    assert [b.num_rows for b in made] == [256, 256, 189, 1, 1, 1, 1] and [i for b in made for i in b.column(0).to_pylist()] == list(range(len(html)))
    fields = [f for b in made for f in b.column(1).to_pylist()]
    assert [f is None for f in fields] == [i % 5 == 0 for i in range(len(html))] and all(len(f["links"]) == 1 for f in fields[:700] if f)
    assert list(E._extracted(iter([pa.RecordBatch.from_arrays([c[:0] for c in columns], names=["_url", "_html", "_wanted", "page_id"])]))) == []
