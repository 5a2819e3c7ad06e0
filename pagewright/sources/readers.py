"""Readers: audit files by version, sitemaps through their indexes, policy files."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions.dims import BITS
from pagewright.functions.sitemaps import MOST_BYTES, read_sitemap
from pagewright.operators.policy import Policy
from pagewright.session import cut_lineage

AUDIT_VERSION = 2
AUDIT_SCHEMA = "format_version int, crawl_id long, site string, counts array<struct<check:string,affected:long>>"


def audits(spark: SparkSession, path: str, version: int = AUDIT_VERSION) -> DataFrame:
    """crawl_id, site, counts of the audit files (a JSON object a line) of this version; checks that are not known are dropped.

    The version is judged before anything else of a line is used; other versions and broken lines are in rejected_audits.
    """
    rows = spark.read.schema(AUDIT_SCHEMA).json(path).where(F.col("format_version") == version)
    known = F.filter("counts", lambda c: c["check"].isin(*BITS))
    return rows.select("crawl_id", "site", known.alias("counts"))


def rejected_audits(spark: SparkSession, path: str, version: int = AUDIT_VERSION) -> DataFrame:
    """format_version, n: lines of other versions, and null for lines that are no audit."""
    lines = spark.read.text(path).select(F.get_json_object("value", "$.format_version").cast("int").alias("format_version"))
    return lines.where(~F.col("format_version").eqNullSafe(F.lit(version))).groupBy("format_version").agg(F.count("*").alias("n"))


_PARSED = "file string, kind string, locs array<string>, dates array<string>, error string"


def _read_sitemaps(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of output a file, so that no more than one file's addresses are held."""
    strings = pa.list_(pa.string())
    for part in parts:
        for file, body in zip(part.column(0), part.column(1)):
            m = read_sitemap(body.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([file.as_py()]), pa.array([m.kind]), pa.array([m.locs], strings), pa.array([m.dates], strings), pa.array([m.error], pa.string())], names=["file", "kind", "locs", "dates", "error"])


def bodies(spark: SparkSession, folder: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """path, body of every file under folder, whatever store Spark reaches it in, with the columns of its partition folders.

    A file of more than most_bytes has a null body; its bytes are not read.
    """
    files = spark.read.format("binaryFile").load(folder)
    rest = [c for c in files.columns if c not in ("path", "content", "length", "modificationTime")]
    whole = files.where(F.col("length") <= most_bytes).select("path", F.col("content").alias("body"), *rest)
    return whole.unionByName(files.where(F.col("length") > most_bytes).select("path", F.lit(None).cast("binary").alias("body"), *rest))


def sitemap_files(files: DataFrame, roots: DataFrame, depth: int = 2, most_files: int = 100) -> DataFrame:
    """site, file, parent, depth, kind, locs, dates, error: the files that are reached from each site's roots (site, file).

    files: file (its address), and body (bytes, plain or gzip) or xml (text). Indexes are followed to depth; a site has most_files
    at most, those of the least depth first, then by address; a file that is named twice counts once. files is parsed once. The
    rounds carry places in the tree only; contents meet them at the end.
    """
    body = F.col("body") if "body" in files.columns else F.encode("xml", "utf-8")
    parsed = cut_lineage(files.select("file", body.alias("body")).mapInArrow(_read_sitemaps, _PARSED))
    names, indexes = parsed.select("file"), parsed.where("kind = 'index'").select("file", "locs")
    level = roots.select("site", "file", F.lit(None).cast("string").alias("parent")).dropDuplicates(["site", "file"])
    seen = None
    for d in range(depth + 1):
        level = level.join(names, "file", "left_semi").select("site", "file", "parent", F.lit(d).alias("depth"))
        level = cut_lineage(level if seen is None else level.join(seen, ["site", "file"], "left_anti"))
        seen = level if seen is None else seen.unionByName(level)
        if d == depth:
            break
        named = level.join(indexes, "file").select("site", F.col("file").alias("parent"), F.explode("locs").alias("file"))
        level = named.groupBy("site", "file").agg(F.min("parent").alias("parent"))
        if level.isEmpty():
            break
    place = F.row_number().over(Window.partitionBy("site").orderBy("depth", "file"))
    first = seen.withColumn("place", place).where(F.col("place") <= most_files).drop("place")
    return first.join(parsed, "file").select("site", "file", "parent", "depth", "kind", "locs", "dates", "error")


def sitemap_tally(files: DataFrame, today: str) -> DataFrame:
    """site, file, parent, depth, kind, failed, listed, with_date, days, first, last, future of each of sitemap_files' rows.

    Dates are told apart by their first ten characters; those after today are future ones. An index has no dates.
    """
    dates = F.when(F.col("kind") == "urls", F.filter("dates", lambda d: d.isNotNull())).otherwise(F.array().cast("array<string>"))
    size = lambda c: F.size(c).cast("long")
    return files.withColumn("days", dates).select(
        "site", "file", "parent", "depth", "kind", (F.col("kind") == "invalid").alias("failed"), size("locs").alias("listed"), size("days").alias("with_date"),
        size(F.array_distinct("days")).alias("days"), F.array_min("days").alias("first"), F.array_max("days").alias("last"), size(F.filter("days", lambda d: d > today)).alias("future"),
    )


def above(files: DataFrame) -> DataFrame:
    """site, file, above, up: every file of a site with itself and the files that it hangs under, and how many steps up.

    files: rows of sitemap_files. A round goes up one level for all; a file's parent is less deep, so there are as many rounds as
    levels and no cycles.
    """
    parents = files.where("parent is not null").select("site", F.col("file").alias("above"), F.col("parent").alias("next"))
    level = files.select("site", "file", F.col("file").alias("above"), F.lit(0).alias("up"))
    out = level
    for up in range(1, (files.agg(F.max("depth")).head()[0] or 0) + 1):
        level = level.join(parents, ["site", "above"]).select("site", "file", F.col("next").alias("above"), F.lit(up).alias("up"))
        out = out.unionByName(level)
    return out


def sitemap_urls(files: DataFrame) -> DataFrame:
    """site, url, file: the addresses that a site's files list, each once, with the first file by address."""
    rows = files.where("kind = 'urls'").select("site", F.explode("locs").alias("url"), "file")
    return rows.groupBy("site", "url").agg(F.min("file").alias("file"))


def set_hash(urls: DataFrame, by: list[str], url: str = "url") -> DataFrame:
    """by, urls, hash: the distinct addresses of each group in one value that does not depend on their order.

    It joins the sums of four parts of the addresses' MD5 digests, so that partial sums meet and no group is collected.
    """
    digest = F.md5(url)
    parts = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    rows = urls.select(*by, url).distinct()
    sums = rows.groupBy(*by).agg(F.count("*").alias("urls"), *(F.sum(p).alias(f"s{k}") for k, p in enumerate(parts)))
    return sums.select(*by, "urls", F.concat_ws("-", *(F.col(f"s{k}").cast("string") for k in range(4))).alias("hash"))


_SECTIONS = {
    "address": {"scheme", "host", "slash"},
    "index": {"rules"},
    "params": {"ignore", "pagination"},
    "must_work": {"urls"},
}


def policy_file(text: str) -> tuple[Policy, list[str]]:
    """A policy of a TOML text, and the keys in it that are not known. A text that is no TOML raises ValueError."""
    tables = tomllib.loads(text)
    unknown = [s for s in tables if s not in _SECTIONS]
    unknown += [f"{s}.{k}" for s in _SECTIONS for k in tables.get(s, {}) if k not in _SECTIONS[s]]
    get = lambda s, k, default: tables.get(s, {}).get(k, default)
    rules = tuple((r["path"], r["stance"]) for r in get("index", "rules", []))
    policy = Policy(
        get("address", "scheme", "https"), get("address", "host", ""), get("address", "slash", "either"), rules,
        tuple(get("params", "ignore", [])), get("params", "pagination", ""), tuple(get("must_work", "urls", [])),
    )
    return policy, sorted(unknown)
