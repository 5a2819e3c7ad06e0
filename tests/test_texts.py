"""Decoding of bodies, widths and cuts of lines against plain versions."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from pagewright.functions.charset import decoded, encoding
from pagewright.functions.dims import ADVANCES, CAPITAL, OTHER, UNITS
from pagewright.operators import texts as T


def test_encodings():
    page = "<p>Größe — “x”</p>"
    meta = b"<meta charset='windows-1252'>"
    cases = [
        (b"\xef\xbb\xbf" + page.encode(), "text/html; charset=latin1", ("utf-8", page)),
        (b"\xff\xfe" + page.encode("utf-16-le"), None, ("utf-16-le", page)), (b"\xfe\xff" + page.encode("utf-16-be"), None, ("utf-16-be", page)),
        (page.encode("cp1252"), 'text/html; charset="ISO-8859-1"; x', ("windows-1252", page)), (page.encode(), "text/html; charset=nonsense", ("utf-8", page)),
        (meta + page.encode("cp1252"), "text/html", ("windows-1252", meta.decode() + page)),
        (b"<META http-equiv=Content-Type content='text/html; charset=shift_jis'>" + "日本".encode("cp932"), None, ("cp932", "<META http-equiv=Content-Type content='text/html; charset=shift_jis'>日本")),
        (b"<!-- " + meta + b"--><meta name=a content='>' charset=utf-16>x", None, ("utf-8", "<!-- " + meta.decode() + "--><meta name=a content='>' charset=utf-16>x")),
        (b"<!-- open " + meta, None, ("utf-8", "<!-- open " + meta.decode())), (b" " * 1024 + meta + b"\xe9", None, ("utf-8", " " * 1024 + meta.decode() + "�")),
        (b"", None, ("utf-8", "")), (b"\xff", None, ("utf-8", "�")), (b"<meta charset=x-user-defined>\x80", None, ("windows-1252", "<meta charset=x-user-defined>€")),
    ]
    for data, header, want in cases:
        assert decoded(data, header) == want, data
    assert encoding("UTF8 ") == "utf-8" and encoding("rot13") is None and encoding("") is None and encoding("koi8-r") == "koi8-r"


def test_bodies_of_a_table(spark):
    rows = [(1, "é".encode("cp1252"), "charset=latin1"), (2, None, "text/html"), (3, bytearray(b"ok"), None), (4, b"", "")]
    got = T.decoded_bodies(spark.createDataFrame(rows, "id long, body binary, type string"), "id", "body", "type").collect()
    assert {tuple(r) for r in got} == {(1, "windows-1252", "é"), (2, None, None), (3, "utf-8", "ok"), (4, "utf-8", "")}


def units(text):
    known = {c: u for u, chars in ADVANCES for c in chars}
    wide = lambda o: 0x1100 <= o <= 0x115F or 0x2E80 <= o <= 0xA4CF or 0xAC00 <= o <= 0xD7A3 or 0x1F300 <= o <= 0x1FAFF
    return sum(known.get(c, UNITS if wide(ord(c)) else CAPITAL if c.isupper() else OTHER) for c in text)


def pixels(text, size):
    return (units(text) * size + UNITS // 2) // UNITS


def fitted(text, limit, size):
    text = text.strip(" ")
    if pixels(text, size) <= limit:
        return text
    if pixels(" …", size) > limit:
        return ""
    cut = max((text[:k].rstrip(" ") for k in range(len(text) + 1) if pixels(text[:k].rstrip(" ") + " …", size) <= limit), key=len)
    at = cut.rfind(" ")
    if at >= 0 and len(cut[:at].encode()) >= len(cut.encode()) * 2 // 3:
        cut = cut[:at].rstrip(" ")
    return cut + " …"


def test_widths_and_cuts(spark):
    rng = random.Random(6)
    texts = ["", " ", "a", "東京タワー 東京タワー", "👍🏽 family 👨‍👩‍👧 of emoji", "WWW mmm", "x" * 3000, "ÀÉ ğ Ж жук", "tail of blanks      "]
    texts += ["".join(rng.choice("abc iWM…—東👍É 'x ") for _ in range(rng.randrange(60))) for _ in range(150)]
    frame = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "id long, text string")
    for limit, size in ((580, 20), (120, 20), (60, 14), (10, 20)):
        rows = frame.select("id", T.width(F.col("text"), size).alias("w"), T.fitted(F.col("text"), limit, size).alias("t")).collect()
        for r in rows:
            if r.id < 0:
                assert r.w is None
            else:
                assert r.w == pixels(texts[r.id], size) and r.t == fitted(texts[r.id], limit, size), texts[r.id]
                assert pixels(r.t, size) <= limit
