"""Writers: crawls as partitioned tables with the newest two kept, and issues as lines of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_crawls(pages: DataFrame, folder: str) -> None:
    """pages (with site_id and crawl_id) by crawl; rewriting a crawl replaces its own partition only."""
    pages.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("site_id", "crawl_id").parquet(folder)


def newest(crawls: DataFrame, most: int = 2) -> DataFrame:
    """site_id, crawl_id of the newest finished crawls of each site (partial ranks before the shuffle)."""
    done = crawls.where("status = 'done'").select("site_id", "crawl_id", "finished_at")
    place = F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("finished_at"), F.desc("crawl_id")))
    return done.withColumn("place", place).where(F.col("place") <= most).select("site_id", "crawl_id")


def finalised(pages: DataFrame, crawls: DataFrame, folder: str, most: int = 2) -> DataFrame:
    """Writes the pages of each site's newest crawls and gives them back; pages of other crawls are left behind.

    What is written is a new folder; readers move to it when it is whole, so a lost job leaves the old one as it was.
    """
    write_crawls(pages.join(newest(crawls, most), ["site_id", "crawl_id"], "left_semi"), folder)
    return pages.sparkSession.read.schema(pages.schema).parquet(folder)


def _quoted(c: Column) -> Column:
    c = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_line(*columns: Column) -> Column:
    """One line of CSV; values with commas, quotes or line breaks are quoted."""
    return F.concat_ws(",", *map(_quoted, columns))


def json_line(**columns: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(k) for k, c in columns.items())))


def markdown_line(*columns: Column) -> Column:
    """A row of a Markdown table; bars are escaped."""
    cell = lambda c: F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    return F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |"))


def annotation_line(severity: Column, title: Column, message: Column) -> Column:
    """A workflow annotation: critical is an error; percent signs, colons, commas and line breaks are escaped."""
    level = F.when(severity == "critical", "error").when(severity == "warning", "warning").otherwise("notice")
    plain = lambda c: F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))
    name = F.replace(F.replace(plain(title), F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C"))
    return F.concat(F.lit("::"), level, F.lit(" title="), name, F.lit("::"), plain(message))


def sarif_result(rule: Column, severity: Column, url: Column) -> Column:
    """One result of a SARIF 2.1.0 run."""
    level = F.when(severity == "critical", "error").when(severity == "warning", "warning").otherwise("note")
    place = F.array(F.struct(F.struct(F.struct(url.alias("uri")).alias("artifactLocation")).alias("physicalLocation")))
    return F.to_json(F.struct(rule.alias("ruleId"), level.alias("level"), F.struct(rule.alias("text")).alias("message"), place.alias("locations")))


def fitted(lines: DataFrame, by: str, order: str, overhead: int, budget: int) -> DataFrame:
    """by, order, line: the first lines of each message that fit into budget bytes, each with its overhead, and a line "N more".

    No more than budget / overhead lines can fit, so that many are taken before the running sum (a limit that Spark applies
    before the shuffle); the others are only counted.
    """
    place = Window.partitionBy(by).orderBy(order)
    first = lines.withColumn("place", F.row_number().over(place)).where(F.col("place") <= budget // overhead)
    fit = first.withColumn("used", F.sum(F.octet_length("line") + overhead).over(place)).where(F.col("used") <= budget)
    counts = lines.groupBy(by).agg(F.count("*").alias("n")).join(fit.groupBy(by).agg(F.count("*").alias("m")), by, "left")
    left = F.col("n") - F.coalesce("m", F.lit(0))
    more = counts.where(left > 0).select(by, F.lit(None).cast(lines.schema[order].dataType).alias(order), F.concat(left.cast("string"), F.lit(" more")).alias("line"))
    return fit.select(by, order, "line").unionByName(more)
