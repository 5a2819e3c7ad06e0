"""Differences by lines and by keys, and suggested robots files."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions.robots_edit import Intent
from pagewright.operators import edits as E
from pagewright.plans.registry import query
from pagewright.plans.site_files import _AFTER, _BEFORE, site_files

WANTED = Intent({"training": "block", "search": "allow"}, {"ClaudeBot": "allow", "Bingbot": "any", "OwnBot": "block"})


@query("po7")
def po7(spark, sf_dir):
    """The robots file that each site should have for the policy, and the lines it takes. Tests hold it against the verdicts."""
    return E.suggestions(site_files(spark, sf_dir), ["site"], WANTED)


@query("po7_diff")
def po7_diff(spark, sf_dir):
    """Each site's robots file of one crawl against that of the next, line by line. Tests hold it against a plain table of
    common lines."""
    before, after = (site_files(spark, sf_dir, seen).withColumnRenamed("body", c) for seen, c in ((_BEFORE, "before"), (_AFTER, "after")))
    return E.line_diffs(before.join(after, "site", "full"), ["site"], "before", "after")


#: An order as a JSON document, three levels deep; members may be missing, null, or of another kind.
_BAND = """CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '4' ELSE concat('{"high":', CASE WHEN o_totalprice > 150000 THEN 'true' ELSE 'false' END, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat(',"step":', CAST(o_custkey % 4 AS INTEGER)) END, '}') END"""
_PARTS = {
    "status": """concat('"', o_orderstatus, '"')""",
    "price.whole": "CAST(CAST(floor(o_totalprice) AS BIGINT) AS {text})",
    "price.band": _BAND,
    "priority": """CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'null' ELSE concat('"', o_orderpriority, '"') END""",
    "days": "concat('[', CAST(year(o_orderdate) AS {text}), ',', CAST(month(o_orderdate) AS {text}), ']')",
}


_DOCUMENT = """concat('{"status":', status, ',"price":{"whole":', whole, coalesce(concat(',"band":', band), ''), '}', coalesce(concat(',"priority":', priority), ''), ',"days":', days, '}')"""
_INNER = """CASE WHEN {s} LIKE '{{%' THEN nullif(regexp_extract({s}, '"{k}":([a-z0-9]+)', 1), '') END"""


def _changed_sql() -> str:
    rows = [f"SELECT o_orderkey, '{k}' AS path, a.\"{k}\" AS before, b.\"{k}\" AS after FROM pairs" for k in ("status", "price.whole", "priority", "days")]
    # Where both sides have an object, or one has and the other nothing, its members are compared; else the whole.
    whole = "coalesce(a.\"price.band\" NOT LIKE '{%', false) OR coalesce(b.\"price.band\" NOT LIKE '{%', false)"
    rows.append(f"SELECT o_orderkey, 'price.band', a.\"price.band\", b.\"price.band\" FROM pairs WHERE {whole}")
    for k in ("high", "step"):
        before, after = (_INNER.format(s=f'{t}."price.band"', k=k) for t in "ab")
        rows.append(f"SELECT o_orderkey, 'price.band.{k}', {before}, {after} FROM pairs WHERE NOT ({whole})")
    parts = ", ".join(f"{e.replace('{text}', 'VARCHAR')} AS \"{k}\"" for k, e in _PARTS.items())
    return (
        f"WITH p AS (SELECT o_orderkey, {parts} FROM orders), pairs AS (SELECT a.o_orderkey, a, b FROM p a JOIN p b ON b.o_orderkey = a.o_orderkey + 1), "
        f"rows AS ({' UNION ALL '.join(rows)}) SELECT * FROM rows WHERE before IS DISTINCT FROM after"
    )


@query("changed_keys", _changed_sql())
def changed_keys(spark, sf_dir):
    """Keys in which the document of an order differs from that of the next."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey", *[f"{e.replace('{text}', 'STRING')} AS `{k.split('.')[-1]}`" for k, e in _PARTS.items()])
    documents = orders.select("o_orderkey", F.expr(_DOCUMENT).alias("before"))
    following = documents.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("before").alias("after"))
    return E.changed_keys(documents.join(following, "o_orderkey"), ["o_orderkey"], "before", "after")
