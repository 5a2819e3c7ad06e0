"""Reads of the page table: filters, search, pages of rows, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.dims import BITS


def page_filter(key: str) -> Column:
    """The filter that a short key names; an unknown key passes all."""
    status, kind = F.col("status"), F.coalesce(F.col("content_type"), F.lit(""))
    html, image = kind.ilike("text/html%"), kind.ilike("image/%")
    simple = {
        "s2": status.between(200, 299), "s3": status.between(300, 399), "s4": status.between(400, 499), "s5": status.between(500, 599), "s0": status == 0,
        "ix": F.col("indexability") == "indexable", "nx": F.col("indexability") != "indexable", "html": html, "img": image, "oth": ~(html | image),
    }
    if key.startswith("check:") and key[6:] in BITS:
        return F.getbit("issues", F.lit(BITS[key[6:]])) == 1
    return simple.get(key, F.lit(True))


def like_literal(text: str) -> str:
    """text with the wildcards of LIKE escaped."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def search(pages: DataFrame, text: str | None) -> DataFrame:
    """Pages whose url or title holds text in any case; no text passes all."""
    if text is None:
        return pages
    pattern = f"%{like_literal(text)}%"
    return pages.where(F.col("url").ilike(pattern) | F.col("title").ilike(pattern))


def page_of_rows(pages: DataFrame, after: int, size: int) -> DataFrame:
    """The next rows by id (a page is the feature): no offset is skipped through."""
    return pages.where(F.col("page_id") > after).orderBy("page_id").limit(size)


def top_folder(path: Column) -> Column:
    """First segment of a path when more follows, else ''."""
    return F.regexp_extract(path, "^/([^/]+)/", 1)


def host_key(host: Column) -> Column:
    """Host in lower case without one leading www."""
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def guarded(text: Column) -> Column:
    """A CSV cell that no spreadsheet takes for a formula."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a glob in which * matches anything."""
    import re

    return "^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"


def glob_match(path: Column, query: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Whether a glob matches; the query counts only where the pattern has a question mark."""
    subject = F.when(query != "", F.concat(path, F.lit("?"), query)).otherwise(path) if "?" in pattern else path
    return subject.rlike(("(?i)" if ignore_case else "") + glob_regex(pattern))


def scheduled(rows: DataFrame, week_hash: Column, hour_hash: Column, zone: Column, after: Column) -> DataFrame:
    """rows with weekly and daily: the next slots strictly after a time.

    The week starts on Monday at 00:00 UTC, and week_hash says how far into it; the day's slot is a full hour of the zone
    by hour_hash. A local time that a change of clocks skips becomes the next one that there is. Missed slots are not made up.
    """
    week, monday = 7 * 86400, 4 * 86400
    t = F.floor(F.unix_micros(after.cast("timestamp")) / 1_000_000)
    slot = F.floor((t - monday) / week) * week + monday + F.pmod(week_hash, F.lit(week))
    weekly = F.timestamp_seconds(F.when(slot <= t, slot + week).otherwise(slot))
    day = F.to_date(F.from_utc_timestamp(after.cast("timestamp"), zone))
    hour = F.pmod(hour_hash, F.lit(24)).cast("int")
    local = F.array(*(F.to_utc_timestamp(F.make_timestamp_ntz(F.year(d), F.month(d), F.day(d), hour, F.lit(0), F.lit(0)).cast("timestamp"), zone) for d in (day, F.date_add(day, 1), F.date_add(day, 2))))
    daily = F.array_min(F.filter(local, lambda x: x > after.cast("timestamp")))
    return rows.withColumns({"weekly": weekly, "daily": daily})
