"""Fields and links of HTML pages, URLs, sitemaps and llms.txt: small parsers that run on Arrow batches."""

import hashlib
import json
import posixpath
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import quote, unquote, urljoin, urlsplit, urlunsplit
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructType

from pagewright.functions.dims import BOTS

MOST_LINKS = 5000
_SPACE = re.compile(r"\s+")


#: Addresses in their one form already, absolute or from a host's root, but for a fragment.
_PLAIN = re.compile(r"(https?://[a-z0-9.-]*[a-z0-9-])?(/[\w~!$&'()*+,=:@/.-]*)?(\?[\w~!$&'()*+,=:@/?.-]*)?(?:#[!-~]*)?", re.ASCII)


def normalised_url(base: str | None, href: str | None) -> str | None:
    """An absolute http(s) URL without fragment: host in lower case, default port dropped, escapes in one form."""
    href = (href or "").strip()
    if not href or href.startswith("#"):
        return None
    plain = None if "/." in href else _PLAIN.fullmatch(href)
    if plain:
        origin, path, query = plain.groups()
        query = query if query and len(query) > 1 else ""
        if origin:
            return f"{origin}{path or '/'}{query}" if _readable(base) else None
        if path and not path.startswith("//"):
            root = _root(base)
            return root and f"{root}{path}{query}"
    return _joined(base, href)


@lru_cache(256)
def _readable(base: str | None) -> bool:
    try:
        urlsplit(base or "")
        return True
    except ValueError:
        return False


@lru_cache(256)
def _root(base: str | None) -> str | None:
    """Scheme and host of an address, without a slash at the end."""
    root = _joined(base, "/")
    return root and root[:-1]


def _joined(base: str | None, href: str) -> str | None:
    try:
        u = urlsplit(urljoin(base or "", href))
        port = u.port
    except ValueError:
        return None
    if u.scheme.lower() not in ("http", "https") or not u.hostname:
        return None
    host = u.hostname.lower().removesuffix(".")
    if port and port != {"http": 80, "https": 443}[u.scheme.lower()]:
        host = f"{host}:{port}"
    path = u.path or "/"
    if "/." in path:
        end = "/" if path.endswith(("/", "/.", "/..")) else ""
        path = (posixpath.normpath(path).replace("//", "/").rstrip("/") + end) or "/"
    one = lambda s, safe: quote(unquote(s, errors="surrogateescape"), safe=safe, errors="surrogateescape")
    return urlunsplit((u.scheme.lower(), host, one(path, "/%!$&'()*+,;=:@~"), one(u.query, "/?%!$&'()*+,;=:@~[]"), ""))


#: Names of metas that address one crawler, besides the tokens of all bots.
BOT_METAS = frozenset("googlebot googlebot-news bingbot msnbot applebot amazonbot amzn-searchbot".split()) | {b[0].lower() for b in BOTS}
MOST_BOT_METAS = 16
#: Ids (and the tag) of elements that scripts render a page into.
MOUNTS = ("root", "app", "__next", "__nuxt", "___gatsby", "q-app", "svelte")
#: What notices to readers without scripts say.
SCRIPT_NOTICES = ("enable javascript", "javascript is disabled", "requires javascript", "without javascript enabled", "turn on javascript", "javascript must be enabled")
_LOADING = frozenset("img script iframe video audio source embed".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Parts:
    """Which named parts of a page are open: kept while elements come and go, whatever is left unclosed."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.open: dict[str, int] = {}
        self.depths: dict[str, int] = {}
        self.texts: dict[str, list[str]] = {"nosnippet": [], "main": [], "mount": [], "noscript": []}
        self.mount: str | None = None

    def start(self, tag: str, a: dict[str, str]) -> None:
        if tag in _VOID:
            return
        kinds = ()
        if "data-nosnippet" in a and tag in ("span", "div", "section"):
            kinds += ("nosnippet",)
        if tag in ("main", "article") or a.get("role") == "main":
            kinds += ("main",)
        if tag == "noscript":
            kinds += ("noscript",)
        if self.mount is None and (tag == "app-root" or a.get("id") in MOUNTS):
            self.mount = a.get("id") or tag
            kinds += ("mount",)
        self.stack.append((tag, kinds))
        self.depths[tag] = self.depths.get(tag, 0) + 1
        for k in kinds:
            self.open[k] = self.open.get(k, 0) + 1

    def end(self, tag: str) -> None:
        if self.depths.get(tag):
            while True:
                last, kinds = self.stack.pop()
                self.depths[last] -= 1
                for k in kinds:
                    self.open[k] -= 1
                    self.texts[k].append(" ")
                if last == tag:
                    return

    def text(self, data: str, visible: bool) -> None:
        for k, n in self.open.items():
            texts = self.texts[k]
            if n and (visible or k == "noscript"):
                texts.append(data)

    def words(self, kind: str) -> list[str]:
        return "".join(self.texts[kind]).split()


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title: list[str] = []
        self.titles = 0
        self.headings: dict[str, list[list[str]]] = {"h1": [], "h2": []}
        self.metas: dict[str, list[str]] = {}
        self.canonical: str | None = None
        self.base: str | None = None
        self.links: list[tuple[str, list[str], bool]] = []
        self.images_missing_alt = 0
        self.jsonld: list[str] = []
        self.words: list[str] = []
        self.open: str | None = None
        self.heading: list[str] | None = None
        self.anchor: list[str] | None = None
        self.hreflang: list[tuple[str, str]] = []
        self.bot_metas: list[tuple[str, str]] = []
        self.markdown: str | None = None
        self.external_scripts = 0
        self.inline_script = False
        self.plain_loads = 0
        self.parts = _Parts()

    def updatepos(self, i, j):
        """Lines are not counted, as nothing asks for a place."""
        return j

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.parts.end(tag)

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        self.words.append(" ")
        self.parts.start(tag, a)
        loaded = a.get("href") if tag == "link" and "stylesheet" in a.get("rel", "").lower().split() else a.get("src") if tag in _LOADING else None
        if loaded:
            self.plain_loads += loaded.strip().lower().startswith("http://")
        if tag == "script":
            if "src" in a:
                self.external_scripts += 1
            elif a.get("type", "").strip().lower() != "application/ld+json":
                self.inline_script = True
        if tag == "title":
            self.titles += 1
            self.open = "title"
        elif tag in ("script", "style", "template", "noscript"):
            self.open = "jsonld" if tag == "script" and a.get("type", "").lower() == "application/ld+json" else "skip"
            if self.open == "jsonld":
                self.jsonld.append("")
        elif tag in self.headings:
            self.heading = []
            self.headings[tag].append(self.heading)
        elif tag == "meta":
            name = (a.get("name") or a.get("property") or "").lower()
            if name:
                self.metas.setdefault(name, []).append(a.get("content", ""))
            if name.strip() in BOT_METAS and "content" in a and len(self.bot_metas) < MOST_BOT_METAS:
                self.bot_metas.append((name.strip(), a["content"].strip()))
        elif tag == "base" and self.base is None:
            self.base = a.get("href")
        elif tag == "link":
            rel = a.get("rel", "").lower().split()
            if "canonical" in rel and self.canonical is None:
                self.canonical = a.get("href", "")
            if "alternate" in rel and "hreflang" in a:
                self.hreflang.append((a["hreflang"].strip(), a.get("href", "")))
            if "alternate" in rel and self.markdown is None and is_markdown(a.get("type")):
                self.markdown = a.get("href")
            self.external_scripts += "modulepreload" in rel
        elif tag == "a" and "href" in a and len(self.links) < MOST_LINKS:
            self.anchor = []
            self.links.append((a["href"], self.anchor, "rel" in a and "nofollow" in a["rel"].lower().split()))
        elif tag == "img" and "alt" not in a:
            self.images_missing_alt += 1

    def handle_endtag(self, tag):
        self.parts.end(tag)
        if tag in ("title", "script", "style", "template", "noscript"):
            self.open = None
        elif tag in self.headings:
            self.heading = None
        elif tag == "a":
            self.anchor = None

    def handle_data(self, data):
        self.parts.text(data, self.open is None)
        if self.open == "title":
            if self.titles == 1 or not "".join(self.title).strip():
                self.title.append(data)
        elif self.open == "jsonld":
            self.jsonld[-1] += data
        elif self.open is None:
            self.words.append(data)
            if self.heading is not None:
                self.heading.append(data)
            if self.anchor is not None:
                self.anchor.append(data)


def is_markdown(content_type: str | None) -> bool:
    return (content_type or "").split(";")[0].strip().lower() == "text/markdown"


def link_header_alternate(header: str | None) -> str | None:
    """The first target of a Link header that is an alternate of type text/markdown, as written."""
    for target, parameters in re.findall(r"<([^>]*)>([^<]*)", header or ""):
        pairs = [p.split("=", 1) for p in re.split("[;,]", parameters) if "=" in p]
        found = {k.strip().lower(): v.strip().strip('"').strip() for k, v in pairs}
        if "alternate" in found.get("rel", "").lower().split() and is_markdown(found.get("type")) and target.strip():
            return target.strip()
    return None


def _line(parts: list[str], most: int) -> str:
    return _SPACE.sub(" ", "".join(parts)).strip()[:most]


def jsonld_state(blocks: list[str]) -> str:
    if not blocks:
        return "absent"
    if any(len(b) > 1 << 20 for b in blocks):
        return "too_large"
    try:
        for b in blocks:
            json.loads(b)
    except ValueError:
        return "invalid"
    return "valid"


def extract(url: str | None, html: str | None) -> dict:
    """The fields of one page. Broken markup is read as far as it goes."""
    r = _Reader()
    r.feed(html or "")
    r.close()
    base = urljoin(url or "", r.base) if r.base else url
    words = "".join(r.words).split()
    first = lambda name: next(iter(r.metas.get(name, ())), None)
    links = []
    for href, anchor, nofollow in r.links:
        target = normalised_url(base, href)
        if target:
            links.append({"url": target, "anchor": _line(anchor, 200), "nofollow": nofollow})
    heads = lambda h: [t for t in (_line(x, 300) for x in r.headings[h]) if t][:50]
    return {
        "title": _line(r.title, 1000), "title_count": r.titles, "h1": heads("h1"), "h2": heads("h2"), "description": first("description"),
        "meta_robots": ", ".join(r.metas["robots"]) if "robots" in r.metas else None, "og_title": first("og:title"), "og_image": first("og:image"),
        "canonical": normalised_url(base, r.canonical) if r.canonical else None, "word_count": len(words),
        "images_missing_alt": r.images_missing_alt, "jsonld": jsonld_state(r.jsonld), "links": links,
        "hreflang": [{"lang": lang, "url": u} for lang, h in r.hreflang if (u := normalised_url(base, h))], "bot_metas": [{"name": n, "content": c} for n, c in r.bot_metas],
        "tdm_reservation": first("tdm-reservation") or None, "tdm_policy": first("tdm-policy") or None, "markdown": normalised_url(base, r.markdown) if r.markdown else None,
        "nosnippet_words": len(r.parts.words("nosnippet")), "main_words": len(r.parts.words("main")), "external_scripts": r.external_scripts, "inline_script": r.inline_script,
        "mount": r.parts.mount, "mount_empty": r.parts.mount is not None and not r.parts.words("mount"),
        "script_notice": any(p in " ".join(r.parts.words("noscript")).lower() for p in SCRIPT_NOTICES),
        "content_key": hashlib.sha256(" ".join(words).encode("utf-8", "replace")).hexdigest(), "mixed_content": r.plain_loads if (url or "").lower().startswith("https://") else 0,
    }


FIELDS = pa.struct([
    ("title", pa.string()), ("title_count", pa.int32()), ("h1", pa.list_(pa.string())), ("h2", pa.list_(pa.string())), ("description", pa.string()), ("meta_robots", pa.string()),
    ("og_title", pa.string()), ("og_image", pa.string()), ("canonical", pa.string()), ("word_count", pa.int32()), ("images_missing_alt", pa.int32()), ("jsonld", pa.string()),
    ("links", pa.list_(pa.struct([("url", pa.string()), ("anchor", pa.string()), ("nofollow", pa.bool_())]))),
    ("hreflang", pa.list_(pa.struct([("lang", pa.string()), ("url", pa.string())]))), ("bot_metas", pa.list_(pa.struct([("name", pa.string()), ("content", pa.string())]))),
    ("tdm_reservation", pa.string()), ("tdm_policy", pa.string()), ("markdown", pa.string()), ("nosnippet_words", pa.int32()), ("main_words", pa.int32()),
    ("external_scripts", pa.int32()), ("inline_script", pa.bool_()), ("mount", pa.string()), ("mount_empty", pa.bool_()), ("script_notice", pa.bool_()), ("content_key", pa.string()), ("mixed_content", pa.int32()),
])
FIELDS_DDL = (
    "struct<title:string,title_count:int,h1:array<string>,h2:array<string>,description:string,meta_robots:string,og_title:string,og_image:string,canonical:string,"
    "word_count:int,images_missing_alt:int,jsonld:string,links:array<struct<url:string,anchor:string,nofollow:boolean>>,"
    "hreflang:array<struct<lang:string,url:string>>,bot_metas:array<struct<name:string,content:string>>,tdm_reservation:string,tdm_policy:string,markdown:string,nosnippet_words:int,"
    "main_words:int,external_scripts:int,inline_script:boolean,mount:string,mount_empty:boolean,script_notice:boolean,content_key:string,mixed_content:int>"
)


#: What a worker holds as Python values at a time: html of so many bytes (or one page) and so many pages.
_HELD_BYTES, _HELD_PAGES = 1 << 20, 256


def _runs(html: pa.Array) -> Iterator[tuple[int, int]]:
    """Begin and number of rows of runs that a worker reads at once."""
    begin = size = 0
    for k, n in enumerate(pc.binary_length(html).to_pylist()):
        if k > begin and (size + (n or 0) > _HELD_BYTES or k - begin == _HELD_PAGES):
            yield begin, k - begin
            begin, size = k, 0
        size += n or 0
    if len(html) > begin:
        yield begin, len(html) - begin


def _extracted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns url, html, whether to read it, and others, which are passed on before the fields."""
    for part in parts:
        for begin, n in _runs(part.column(1)):
            piece = part.slice(begin, n)
            rows = [extract(u, h) if wanted else None for u, h, wanted in zip(*(c.to_pylist() for c in piece.columns[:3]))]
            yield pa.RecordBatch.from_arrays([*piece.columns[3:], pa.array(rows, FIELDS)], names=[*piece.schema.names[3:], "fields"])


def extracted_beside(pages: DataFrame, wanted: Column, *others: str) -> DataFrame:
    """The other columns of pages (url, html) and fields, null where a page is not wanted; one pass without a shuffle."""
    rows = pages.select(F.col("url").alias("_url"), F.col("html").cast("string").alias("_html"), F.coalesce(wanted, F.lit(False)).alias("_wanted"), *others)
    return rows.mapInArrow(_extracted, StructType([*rows.schema.fields[3:], *StructType.fromDDL(f"fields {FIELDS_DDL}").fields]))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, fields of pages (page_id, url, html), in one pass without a shuffle."""
    return extracted_beside(pages.withColumn("page_id", F.col("page_id").cast("long")), F.lit(True), "page_id", "url")


@pandas_udf(StringType())
def normalise_udf(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([normalised_url(b, h) for b, h in zip(base, href)], dtype=object)


def sitemap(xml: str | None) -> tuple[str, list[str], list[str | None]]:
    """Kind of a sitemap file, its locations and their dates; broken XML is of kind invalid."""
    try:
        root = ElementTree.fromstring((xml or "").strip())
    except ElementTree.ParseError:
        return "invalid", [], []
    bare = lambda e: e.tag.rsplit("}", 1)[-1]
    kind = {"sitemapindex": "index", "urlset": "urls"}.get(bare(root), "invalid")
    locs, dates = [], []
    for entry in root:
        found = {bare(c): (c.text or "").strip() for c in entry}
        if found.get("loc"):
            locs.append(found["loc"])
            dates.append(found.get("lastmod", "")[:10] or None)
    return kind, locs, dates


def llms_sections(text: str | None) -> dict:
    """Title, summary and linked sections of an llms.txt; lines within code fences are no structure."""
    title = summary = None
    sections: list[dict] = []
    fenced = False
    h1_first = next((x.strip() for x in (text or "").splitlines() if x.strip()), "").startswith("# ")
    for line in (text or "").splitlines():
        s = line.strip()
        if s.startswith(("```", "~~~")):
            fenced = not fenced
        elif fenced or not s:
            continue
        elif s.startswith("# ") and title is None:
            title = s[2:].strip()
        elif s.startswith(">") and summary is None and title is not None:
            summary = s[1:].strip()
        elif s.startswith("## "):
            sections.append({"name": s[3:].strip(), "links": []})
        elif sections:
            sections[-1]["links"] += re.findall(r"\[[^\]]*\]\(([^)\s]+)\)", s)
    return {"title": title, "h1_first": h1_first, "summary": summary, "sections": sections}


LLMS_DDL = "struct<title:string,h1_first:boolean,summary:string,sections:array<struct<name:string,links:array<string>>>>"
