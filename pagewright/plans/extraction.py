"""Extraction of fields and links: in expressions where they suffice, in the parser where not."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import extract as E
from pagewright.plans.fixtures import table
from pagewright.plans.registry import query

_CLEAN_DUCK = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<title.*?</title>|<!--.*?-->', '', 'g'), '<[a-zA-Z!][^>]*>', ' ', 'g'), '</[^>]*>', '', 'g'), '&[a-z]+;', '&', 'g')"


def _text(html):
    """Visible text: opening tags break words, closing tags do not."""
    t = F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>|<title.*?</title>|<!--.*?-->", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"<[a-zA-Z!][^>]*>", " "), r"</[^>]*>", ""), r"&[a-z]+;", "&")


@query("x1a", "SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[ \\t\\n\\r]+', ' ', 'g')) AS title, len(regexp_extract_all(html, '<title[ >]')) AS title_count FROM pages")
def x1a(spark, sf_dir):
    title = F.trim(F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), r"[ \t\n\r]+", " "))
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), F.regexp_count("html", F.lit("<title[ >]")).cast("long").alias("title_count"))


@query("x1b", "SELECT page_id, regexp_extract_all(html, '<h1>([^<]*)</h1>', 1) AS h1, len(regexp_extract_all(html, '<h2[ >]')) AS h2_count FROM pages")
def x1b(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all("html", F.lit("<h1>([^<]*)</h1>"), F.lit(1)).alias("h1"), F.regexp_count("html", F.lit("<h2[ >]")).cast("long").alias("h2_count"))


@query("x1c", "SELECT page_id, regexp_extract(html, '<meta charset=\"([^\"]*)\"', 1) AS charset, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, len(regexp_extract_all(html, '<meta ')) AS metas FROM pages")
def x1c(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("html", '<meta charset="([^"]*)"', 1).alias("charset"), F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"), F.regexp_count("html", F.lit("<meta ")).cast("long").alias("metas")
    )


@query("x1f", "SELECT page_id, i - 1 AS place, hrefs[i] AS href FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS hrefs FROM pages), LATERAL (SELECT unnest(range(1, len(hrefs) + 1)) AS i)")
def x1f(spark, sf_dir):
    """Links of each page in order."""
    hrefs = F.slice(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)), 1, E.MOST_LINKS)
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(hrefs).alias("place", "href")).withColumn("place", F.col("place").cast("long"))


@query("x1g", f"SELECT page_id, len(regexp_extract_all({_CLEAN_DUCK}, '[^ \\t\\n\\r]+')) AS word_count FROM pages")
def x1g(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_count(_text(F.col("html")), F.lit(r"[^ \t\n\r]+")).cast("long").alias("word_count"))


@query("x1h", f"SELECT min(page_id) AS first_page, count(*) AS pages FROM (SELECT page_id, trim(regexp_replace({_CLEAN_DUCK}, '[ \\t\\n\\r]+', ' ', 'g')) AS t FROM pages) GROUP BY t HAVING count(*) > 1")
def x1h(spark, sf_dir):
    """Pages of equal visible text; grouped by a digest, not by the text."""
    t = F.trim(F.regexp_replace(_text(F.col("html")), r"[ \t\n\r]+", " "))
    return table(spark, sf_dir, "pages").groupBy(F.sha2(t, 256).alias("key")).agg(F.min("page_id").alias("first_page"), F.count("*").alias("pages")).where("pages > 1").drop("key")


@query("x1i", "SELECT page_id, len(regexp_extract_all(html, '<img [^>]*>')) - len(regexp_extract_all(html, '<img [^>]*alt=[^>]*>')) AS images_missing_alt, CASE WHEN url LIKE 'https://%' THEN len(regexp_extract_all(html, 'src=\"http://')) ELSE 0 END AS mixed_content FROM pages")
def x1i(spark, sf_dir):
    count = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return table(spark, sf_dir, "pages").select(
        "page_id", (count("<img [^>]*>") - count("<img [^>]*alt=[^>]*>")).alias("images_missing_alt"), F.when(F.col("url").startswith("https://"), count('src="http://')).otherwise(0).alias("mixed_content")
    )


@query("x1")
def x1(spark, sf_dir):
    """All fields of each page by the parser; the tests hold its cases."""
    rows = E.extracted(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "fields.title", "fields.title_count", F.size("fields.h1").alias("h1"), "fields.word_count", "fields.jsonld", F.size("fields.links").alias("links"))


@query("x1_links", "SELECT page_id, CAST(len(regexp_extract_all(html, '<a href=\"/[^\"]*\"')) AS INTEGER) AS links FROM pages")
def x1_links(spark, sf_dir):
    """Links that the parser finds, resolved."""
    return E.extracted(table(spark, sf_dir, "pages")).select("page_id", F.size("fields.links").alias("links"))


@query("x2", "SELECT page_id, concat(regexp_extract(url, '^(https?://[^/?#]*)', 1), '/a/c?x=1') AS url FROM pages")
def x2(spark, sf_dir):
    """A reference resolved against each page and put in one form."""
    return table(spark, sf_dir, "pages").select("page_id", E.normalise_udf("url", F.lit(" /a/./b/../c?x=1#frag ")).alias("url"))


@query("x9", "SELECT page_id // 40 AS file, 'urls' AS kind, count(*) AS urls, count(DISTINCT page_id % 9) AS dates FROM pages GROUP BY 1")
def x9(spark, sf_dir):
    """Sitemap files made of the pages' addresses, parsed: kind, number of addresses, dates."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "&", "&amp;").alias("url"))
    entry = F.concat(F.lit("<url><loc>"), "url", F.lit("</loc><lastmod>2024-01-0"), (1 + F.col("page_id") % 9).cast("string"), F.lit("T00:00:00Z</lastmod></url>"))
    # A file's size is bounded by its format: files hold 40 addresses here.
    files = pages.groupBy(F.floor(F.col("page_id") / 40).alias("file")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(entry), ""), F.lit("</urlset>")).alias("xml"))

    def parse(batches):
        import pandas as pd

        for b in batches:
            found = [E.sitemap(x) for x in b["xml"]]
            yield pd.DataFrame({"file": b["file"], "kind": [k for k, _, _ in found], "urls": [len(u) for _, u, _ in found], "dates": [len({x for x in d if x}) for _, _, d in found]})

    return files.mapInPandas(parse, "file long, kind string, urls long, dates long")


@query("x11", "SELECT page_id // 40 AS file, 'Site' AS title, CAST(2 AS BIGINT) AS sections, count(*) AS links FROM pages GROUP BY 1")
def x11(spark, sf_dir):
    """llms.txt files made of the pages, parsed."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    line = F.concat(F.lit("- [p]("), "url", F.lit("): page\n"))
    head = F.concat(F.lit("# Site\n\n> Summary\n\n## Docs\n"), F.array_join(F.collect_list(line), ""), F.lit("## Optional\n```\n# no\n```\n"))
    files = pages.groupBy(F.floor(F.col("page_id") / 40).alias("file")).agg(head.alias("text"))

    def parse(batches):
        import pandas as pd

        for b in batches:
            found = [E.llms_sections(x) for x in b["text"]]
            yield pd.DataFrame({"file": b["file"], "title": [f["title"] for f in found], "sections": [len(f["sections"]) for f in found], "links": [sum(len(s["links"]) for s in f["sections"]) for f in found]})

    return files.mapInPandas(parse, "file long, title string, sections long, links long")


def _when(condition: str, text: str) -> str:
    return f"CASE WHEN {condition} THEN {text} ELSE '' END"


#: Markup that the test pages lack, put into their heads and bodies by one rule that both sides read.
_HEAD = "concat(" + ", ".join([
    _when("page_id % 4 <> 0", """concat('<link rel="x CANONICAL" href="/c/', CAST(page_id % 7 AS STRING), '">')"""),
    _when("page_id % 3 = 0", """'<link rel="alternate" hreflang="de" href="/de/x"><link rel="alternate" hreflang=" en " href="https://other.example/e#f">'"""),
    _when("page_id % 5 = 0", """'<meta name="GoogleBot" content=" noarchive ">'"""), _when("page_id % 6 = 0", """'<meta name="tdm-reservation" content="1">'"""),
    _when("page_id % 8 = 0", """'<link rel="alternate" type="text/markdown; charset=utf-8" href="/page.md">'"""),
    _when("page_id % 5 = 1", """'<script type="application/ld+json">[1, 2]</script>'"""), _when("page_id % 5 = 2", """'<script type="application/ld+json">(bad</script>'"""),
    _when("page_id % 2 = 0", """'<script src="/a.js"></script>'"""), "'</head>'",
]) + ")"
_BODY = "concat(" + ", ".join([
    _when("page_id % 3 = 1", """concat('<div id="app">', CASE WHEN page_id % 2 = 0 THEN ' <b> </b>' ELSE 'text' END, '</div>')"""),
    _when("page_id % 4 = 1", """'<noscript><p>Please  enable</p> JavaScript</noscript>'"""), _when("page_id % 7 = 0", """'<span data-nosnippet>three <i>hidden</i> words</span>'"""), "'<article>'",
]) + ")"


def enriched(spark, sf_dir):
    html = F.expr(f"replace(replace(html, '</head>', {_HEAD}), '<article>', {_BODY})")
    return E.extracted(table(spark, sf_dir, "pages").select("page_id", "url", html.alias("html"))).select("page_id", "fields.*")


_ORIGIN = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"


@query("x1d", f"SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN concat({_ORIGIN}, '/c/', CAST(page_id % 7 AS VARCHAR)) END AS canonical FROM pages")
def x1d(spark, sf_dir):
    """The canonical address that a page names, resolved."""
    return enriched(spark, sf_dir).select("page_id", "canonical")


@query("x1e", f"SELECT page_id, 'de' AS lang, concat({_ORIGIN}, '/de/x') AS url FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, 'en', 'https://other.example/e' FROM pages WHERE page_id % 3 = 0")
def x1e(spark, sf_dir):
    """Versions of a page in other languages."""
    return enriched(spark, sf_dir).select("page_id", F.inline("hreflang"))


@query("x1j", "SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'valid' WHEN 2 THEN 'invalid' ELSE 'absent' END AS jsonld FROM pages")
def x1j(spark, sf_dir):
    """State of a page's structured data."""
    return enriched(spark, sf_dir).select("page_id", "jsonld")


@query("x1k", "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'googlebot: noarchive' ELSE '' END AS bot_metas, CASE WHEN page_id % 6 = 0 THEN '1' END AS tdm_reservation, CASE WHEN page_id % 7 = 0 THEN 3 ELSE 0 END AS nosnippet_words FROM pages")
def x1k(spark, sf_dir):
    """Metas that address one crawler, reservations, and words kept out of snippets."""
    metas = F.array_join(F.transform("bot_metas", lambda m: F.concat(m["name"], F.lit(": "), m["content"])), "; ")
    return enriched(spark, sf_dir).select("page_id", metas.alias("bot_metas"), "tdm_reservation", "nosnippet_words")


@query("x1l", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END AS external_scripts, CASE WHEN page_id % 3 = 1 THEN 'app' END AS mount, page_id % 3 = 1 AND page_id % 2 = 0 AS mount_empty, page_id % 4 = 1 AS script_notice, html LIKE '%<script>%' AS inline_script FROM pages")
def x1l(spark, sf_dir):
    """Signs of a page that scripts have to fill."""
    return enriched(spark, sf_dir).select("page_id", "external_scripts", "mount", "mount_empty", "script_notice", "inline_script")


@query("x17", f"SELECT page_id, concat({_ORIGIN}, '/page.md') AS markdown FROM pages WHERE page_id % 8 = 0")
def x17(spark, sf_dir):
    """The Markdown version that a page names."""
    return enriched(spark, sf_dir).select("page_id", "markdown").where("markdown IS NOT NULL")
