"""Fixed tables of the audit: checks, severities, kinds of change, bots, engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bit, slug, severity, scope of each check.
CHECKS = (
    (0, "http_4xx", "critical", "page"), (1, "http_5xx", "critical", "page"), (2, "fetch_failed", "critical", "page"),
    (3, "redirect_loop", "critical", "page"), (4, "redirected", "notice", "page"), (5, "redirect_chain", "warning", "page"),
    (6, "noindex", "notice", "page"), (7, "canonicalised", "notice", "page"), (8, "canonical_missing", "notice", "page"),
    (9, "blocked_by_robots", "warning", "page"), (10, "canonical_to_non_200", "warning", "site"), (11, "robots_blocks_site", "critical", "site_wide"),
    (12, "title_missing", "warning", "page"), (13, "title_too_long", "notice", "page"), (14, "title_too_short", "notice", "page"),
    (15, "title_multiple", "warning", "page"), (16, "title_duplicate", "warning", "site"), (17, "description_missing", "warning", "page"),
    (18, "description_too_long", "notice", "page"), (19, "description_too_short", "notice", "page"), (20, "description_duplicate", "warning", "site"),
    (21, "h1_missing", "warning", "page"), (22, "h1_multiple", "notice", "page"), (23, "h1_duplicate", "notice", "site"),
    (24, "thin_content", "notice", "page"), (25, "content_duplicate", "warning", "site"), (26, "images_missing_alt", "notice", "page"),
    (27, "links_to_broken", "warning", "site"), (28, "links_to_redirect", "notice", "site"), (29, "orphan", "warning", "site"),
    (30, "no_internal_outlinks", "notice", "page"), (31, "nofollow_internal_links", "notice", "page"), (32, "deep_page", "notice", "page"),
    (33, "sitemap_non_200", "warning", "site"), (34, "sitemap_noindex", "warning", "site"), (35, "sitemap_canonicalised", "notice", "site"),
    (36, "not_in_sitemap", "notice", "site"), (37, "sitemap_missing", "notice", "site_wide"), (38, "mixed_content", "warning", "page"),
    (39, "not_https", "warning", "page"), (40, "slow_response", "notice", "page"), (41, "og_missing", "notice", "page"),
    (42, "jsonld_invalid", "warning", "page"), (43, "hreflang_missing_self", "notice", "page"), (44, "policy_address", "warning", "page"),
    (45, "policy_index_mismatch", "warning", "page"), (46, "policy_keep_out_partial", "notice", "page"), (47, "policy_param_canonical", "notice", "page"),
    (48, "must_work_failed", "critical", "page"),
)
BITS = {slug: bit for bit, slug, _, _ in CHECKS}
#: The most points a check of a severity can cost.
SEVERITY_POINTS = {"critical": 15, "warning": 5, "notice": 1}
SEVERITY_RANK = {"critical": 0, "warning": 1, "notice": 2}

#: Token, purpose, honours robots.txt, crawls by itself, has a documented user agent string.
BOTS = (
    ("OAI-SearchBot", "search", "yes", True, True), ("Claude-SearchBot", "search", "yes", True, False), ("PerplexityBot", "search", "yes", True, True),
    ("Googlebot", "search", "yes", True, True), ("Applebot", "search", "yes", True, True), ("meta-webindexer", "search", "yes", True, True),
    ("Amzn-SearchBot", "search", "yes", True, False), ("Bingbot", "search", "yes", True, True), ("DuckAssistBot", "search", "yes", True, True),
    ("MistralAI-Index", "search", "unknown", True, True), ("ChatGPT-User", "user_fetch", "partial", True, True), ("Claude-User", "user_fetch", "yes", True, False),
    ("Perplexity-User", "user_fetch", "no", True, True), ("meta-externalfetcher", "user_fetch", "partial", True, True), ("Amzn-User", "user_fetch", "partial", True, False),
    ("MistralAI-User", "user_fetch", "unknown", True, True), ("Google-Agent", "agent", "no", True, False), ("GPTBot", "training", "yes", True, True),
    ("ClaudeBot", "training", "yes", True, True), ("Google-Extended", "training", "yes", False, False), ("Applebot-Extended", "training", "yes", False, False),
    ("meta-externalagent", "training", "yes", True, True), ("Amazonbot", "training", "yes", True, True), ("MistralAI-Training", "training", "yes", True, False),
    ("CCBot", "training", "yes", True, True), ("OAI-AdsBot", "ads", "unknown", True, True), ("meta-externalads", "ads", "yes", True, False),
)
#: Engine, its crawler, words that exclude, words that limit, whether max-snippet and the share rule count.
ENGINES = (
    ("google", "Googlebot", ("noindex", "none", "nosnippet"), (), True, True),
    ("bing", "Bingbot", ("noindex", "none", "noarchive"), ("nocache", "nosnippet"), False, True),
    ("apple", "Applebot", ("noindex", "none"), ("nosnippet",), False, False),
    ("amazon", "Amzn-SearchBot", ("noindex", "none"), (), False, False),
    ("chat_gpt", "OAI-SearchBot", (), (), False, False), ("claude", "Claude-SearchBot", (), (), False, False),
    ("perplexity", "PerplexityBot", (), (), False, False), ("meta_ai", "meta-webindexer", (), (), False, False),
    ("duck_duck_go", "DuckAssistBot", (), (), False, False), ("mistral", "MistralAI-Index", (), (), False, False),
)
#: Kinds of change in their order.
CHANGE_KINDS = (
    "site_moved", "new_url", "removed_url", "status_changed", "became_noindex", "title_removed", "title_changed", "canonical_changed",
    "redirect_chain_grew", "robots_txt_changed", "sitemap_shrank", "error_spike",
)


def checks_dim(spark: SparkSession) -> DataFrame:
    """One row per check; bounded by the width of the mask."""
    return spark.createDataFrame([(*c, SEVERITY_POINTS[c[2]]) for c in CHECKS], "bit int, slug string, severity string, scope string, points int")


def bots_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BOTS, "token string, purpose string, honours string, crawls boolean, has_ua boolean")


def engines_dim(spark: SparkSession) -> DataFrame:
    rows = [(e, c, list(x), list(m), s, h) for e, c, x, m, s, h in ENGINES]
    return spark.createDataFrame(rows, "engine string, crawler string, excluded_by array<string>, limited_by array<string>, max_snippet boolean, share_rule boolean")

#: How wide characters of search results are set, in 2048ths of the size; then where results are cut, in
#: pixels, and the sizes that titles and descriptions are set in.
UNITS = 2048
ADVANCES = (
    (391, "'"), (455, "ijl‘’‚"), (532, "|"), (569, "  !,./:;[\\]ftIìíîïıÌÍÎÏ"), (682, "()-`r"), (683, "“”„·"), (684, "{}"), (717, "•"), (727, '"'), (797, "*"), (961, "^"),
    (1024, "cksvxyzJ"), (1139, "0123456789abdeghnopqu#$?_L–€£¥"), (1196, "+<=>~×"), (1251, "FTZ"), (1366, "ABEKPSVXY&"), (1479, "CDHNRUw"), (1509, "©®"), (1593, "GOQ"), (1706, "Mm"),
    (1821, "%"), (1933, "W"), (2048, "—…™"), (2079, "@"),
)
CAPITAL, OTHER = 1430, 1139
WIDE = r"[\x{1100}-\x{115F}\x{2E80}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE4F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}\x{1F300}-\x{1FAFF}\x{20000}-\x{3FFFD}]"
TITLE_CUT, TITLE_SIZE, DESCRIPTION_CUT, DESCRIPTION_SIZE = 580, 20, 990, 14
