"""Sitemap bodies: gzip, broken and long ones; the tree of files with their tallies."""

from __future__ import annotations

import gzip
import random
import tracemalloc

from pagewright.functions.extract import sitemap
from pagewright.functions.sitemaps import MOST_URLS, read_sitemap
from pagewright.sources import readers


def urlset(*urls, dates=()):
    dates = dict(dates)
    return ("<urlset>" + "".join(f"<url><loc>{u}</loc>" + (f"<lastmod>{dates[u]}</lastmod>" if u in dates else "") + "</url>" for u in urls) + "</urlset>").encode()


def test_plain_and_packed_bodies_agree_with_a_tree_parser():
    rng = random.Random(5)
    for _ in range(60):
        urls = [f"http://a.b/{rng.random()}?x=1&amp;y=é" for _ in range(rng.randrange(400))]
        body = urlset(*urls, dates={u: "2024-02-03T10:00:00Z" for u in urls if rng.random() < 0.5})
        kind, locs, dates = sitemap(body.decode())
        for b in (body, gzip.compress(body), b"\xef\xbb\xbf" + body, gzip.compress(body) + b"rest"):
            got = read_sitemap(b)
            assert (got.kind, got.locs, got.dates, got.error) == (kind, locs, dates, None)


def test_entries_by_their_place():
    body = b"""<?xml version='1.0' encoding='latin-1'?><!-- x --><s:urlset xmlns:s='u'><s:url><image:image xmlns:image='i'><image:loc>no</image:loc></image:image><loc> <![CDATA[a&b]]> </loc><loc></loc></s:url>
    <other><loc>no</loc></other><url><lastmod>2024</lastmod></url><url><loc>caf&#233; &what; \xff</loc><lastmod> 2024-01-02T00 </lastmod></url></s:urlset>"""
    got = read_sitemap(body)
    assert (got.kind, got.locs, got.dates, got.error) == ("urls", ["a&b", "café  �"], [None, "2024-01-02"], None)
    assert read_sitemap(b"<sitemapindex/>")[:2] == ("index", [])


def test_what_came_before_a_break_stays():
    whole = urlset("u1", "u2", "u3")
    got = read_sitemap(whole[: whole.index(b"u3")])
    assert got.locs == ["u1", "u2"] and got.kind == "urls" and got.error.startswith("xml")
    got = read_sitemap(b"<urlset><url><loc>u1</loc></wrong>")
    assert got.locs == ["u1"] and got.error.startswith("xml")
    rng = random.Random(1)
    urls = [f"http://a.b/{rng.random()}" for _ in range(20_000)]
    packed = gzip.compress(urlset(*urls))
    got = read_sitemap(packed[: len(packed) // 2])
    assert got.error.startswith("gzip") and 5_000 < len(got.locs) < 15_000 and got.locs == urls[: len(got.locs)]


def test_no_sitemaps():
    for body in (None, b"", b"   ", b"no xml", b"<html><body>x</body></html>", b"\x1f\x8b", b"\x1f\x8bjunk", b"\x1f\x8b\x08junk", gzip.compress(b"<html/>")):
        got = read_sitemap(body)
        assert got.kind == "invalid" and got.locs == [] and got.error


def test_long_bodies_are_never_held_unpacked():
    many = urlset(*(f"http://a.b/{i}" for i in range(MOST_URLS + 10)))
    assert len(read_sitemap(many).locs) == MOST_URLS
    bomb = gzip.compress(b"<urlset>" + b" " * 200_000_000)
    tracemalloc.start()
    assert read_sitemap(bomb).locs == []
    assert tracemalloc.get_traced_memory()[1] < 4_000_000
    tracemalloc.stop()


def test_tree_of_stored_bodies(spark, tmp_path):
    index = lambda *files: ("<sitemapindex>" + "".join(f"<sitemap><loc>{f}</loc></sitemap>" for f in files) + "</sitemapindex>").encode()
    held = {"r": index("a", "b", "c", "gone"), "a": gzip.compress(urlset("u1", "u2", "u3", dates={"u1": "2024-01-01", "u2": "2024-01-01T01", "u3": "2025-01-01"})), "b": b"\x1f\x8bjunk", "c": urlset("u" * 200)}
    for name, body in held.items():
        (tmp_path / f"file={name}").mkdir()
        (tmp_path / f"file={name}" / "part.bin").write_bytes(body)
    files = readers.bodies(spark, str(tmp_path), most_bytes=200)
    roots = spark.createDataFrame([("s", "r"), ("s", "r"), ("t", "c"), ("t", "nowhere"), (None, None)], "site string, file string")
    found = readers.sitemap_files(files.select("file", "body"), roots)
    got = {(r.site, r.file): tuple(r)[2:] for r in readers.sitemap_tally(found, "2024-06-01").collect()}
    none = (True, 0, 0, 0, None, None, 0)
    assert got == {
        ("s", "r"): (None, 0, "index", False, 4, 0, 0, None, None, 0), ("s", "a"): ("r", 1, "urls", False, 3, 3, 2, "2024-01-01", "2025-01-01", 1),
        ("s", "b"): ("r", 1, "invalid", *none), ("s", "c"): ("r", 1, "invalid", *none), ("t", "c"): (None, 0, "invalid", *none),
    }
    assert readers.sitemap_tally(readers.sitemap_files(files.select("file", "body").limit(0), roots), "2024-06-01").count() == 0
