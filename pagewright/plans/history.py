"""Crawl histories, queues, digests, limits and retention over the crawl and change logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagewright.plans.fixtures import BASE, changes, crawls, table
from pagewright.plans.registry import query

_NOW = "TIMESTAMP '2024-01-28 12:00:00'"
_CNOW = "TIMESTAMP '2001-06-01 00:00:00'"
_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END"


def now():
    return F.expr(_NOW)


def cnow():
    return F.expr(_CNOW)


@query("w1", BASE + "SELECT crawl_id, site_id, row_number() OVER (PARTITION BY site_id ORDER BY created_at, crawl_id) AS number FROM crawls")
def w1(spark, sf_dir):
    """The number of each crawl within its site."""
    return crawls(spark, sf_dir).select("crawl_id", "site_id", F.row_number().over(Window.partitionBy("site_id").orderBy("created_at", "crawl_id")).cast("long").alias("number"))


@query("w2", BASE + """SELECT site_id, crawl_id, number, health_score FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY number DESC) AS r FROM (
 SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY created_at, crawl_id) AS number FROM crawls) WHERE status = 'done') WHERE r <= 12""")
def w2(spark, sf_dir):
    """The newest twelve scores of each site; crawls are numbered before they are filtered."""
    w = Window.partitionBy("site_id")
    rows = crawls(spark, sf_dir).withColumn("number", F.row_number().over(w.orderBy("created_at", "crawl_id"))).where("status = 'done'")
    return rows.withColumn("r", F.row_number().over(w.orderBy(F.desc("number")))).where("r <= 12").select("site_id", "crawl_id", F.col("number").cast("long").alias("number"), "health_score")


@query("w3", BASE + "SELECT site_id, change_id FROM (SELECT *, row_number() OVER (PARTITION BY site_id, kind ORDER BY created_at DESC, change_id DESC) AS r FROM changes) WHERE r <= 20")
def w3(spark, sf_dir):
    """The newest twenty per key that a retention keeps."""
    w = Window.partitionBy("site_id", "kind").orderBy(F.desc("created_at"), F.desc("change_id"))
    return changes(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r <= 20").select("site_id", "change_id")


_MAIL = "lower(concat(CASE WHEN c_custkey % 3 = 0 THEN 'User.' ELSE 'user' END, CAST(c_custkey % 200 AS VARCHAR), CASE WHEN c_custkey % 5 = 0 THEN '+news' ELSE '' END, CASE WHEN c_custkey % 2 = 0 THEN '@gmail.com' ELSE '@example.org' END))"
_CANON = "concat(CASE WHEN split_part(m, '@', 2) = 'gmail.com' THEN replace(split_part(split_part(m, '@', 1), '+', 1), '.', '') ELSE split_part(split_part(m, '@', 1), '+', 1) END, '@', split_part(m, '@', 2))"


def _mails(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_MAIL.replace("VARCHAR", "STRING")).alias("m"))
    return rows.select("c_custkey", "m", F.expr(_CANON).alias("canonical"))


@query("x19", f"SELECT c_custkey, {_CANON} AS canonical FROM (SELECT c_custkey, {_MAIL} AS m FROM customer)")
def x19(spark, sf_dir):
    """Addresses in canonical form: lower case, no tag, no dots where the provider ignores them."""
    return _mails(spark, sf_dir).select("c_custkey", "canonical")


@query("w4", f"SELECT canonical, min(c_custkey) AS keeper, count(*) AS n FROM (SELECT c_custkey, {_CANON} AS canonical FROM (SELECT c_custkey, {_MAIL} AS m FROM customer)) GROUP BY 1")
def w4(spark, sf_dir):
    """One account per canonical address."""
    return _mails(spark, sf_dir).groupBy("canonical").agg(F.min("c_custkey").alias("keeper"), F.count("*").alias("n"))


@query("w5", "SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer) WHERE r > 10")
def w5(spark, sf_dir):
    """Sites of an account beyond a plan's ten."""
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey").withColumn("r", F.row_number().over(w)).where("r > 10").drop("r")


_TREND = "SELECT site_id, crawl_id, health_score - lag(health_score) OVER (PARTITION BY site_id ORDER BY finished_at, crawl_id) AS delta FROM crawls WHERE status = 'done'"


@query("w8", BASE + f", d AS ({_TREND}) SELECT site_id, min(delta) AS biggest_drop, CAST(count(*) FILTER (delta > 0) AS BIGINT) AS rises FROM d GROUP BY 1 HAVING min(delta) <= -3")
def w8(spark, sf_dir):
    """The largest fall of the score between consecutive crawls of a site, from three points on."""
    w = Window.partitionBy("site_id").orderBy("finished_at", "crawl_id")
    rows = crawls(spark, sf_dir).where("status = 'done'").select("site_id", (F.col("health_score") - F.lag("health_score").over(w)).alias("delta"))
    return rows.groupBy("site_id").agg(F.min("delta").alias("biggest_drop"), F.count_if(F.col("delta") > 0).alias("rises")).where("biggest_drop <= -3")


@query("w9", BASE + """, d AS (SELECT DISTINCT site_id, CAST(created_at AS DATE) AS day, kind FROM changes)
SELECT site_id, day, kind, 'new' AS what FROM d a WHERE day > DATE '2024-01-01' AND NOT EXISTS (SELECT 1 FROM d b WHERE b.site_id = a.site_id AND b.kind = a.kind AND b.day = a.day - 1)
UNION ALL SELECT site_id, CAST(day + 1 AS DATE), kind, 'fixed' FROM d a WHERE day < DATE '2024-01-30' AND NOT EXISTS (SELECT 1 FROM d b WHERE b.site_id = a.site_id AND b.kind = a.kind AND b.day = a.day + 1)""")
def w9(spark, sf_dir):
    """Kinds that appear or go from one day to the next."""
    d = changes(spark, sf_dir).select("site_id", F.to_date("created_at").alias("day"), "kind").distinct()
    shifted = lambda n: d.select("site_id", F.date_add("day", n).alias("day"), "kind")
    new = d.where("day > DATE '2024-01-01'").join(shifted(1), ["site_id", "day", "kind"], "left_anti").withColumn("what", F.lit("new"))
    gone = shifted(1).where("day <= DATE '2024-01-30'").join(d, ["site_id", "day", "kind"], "left_anti").withColumn("what", F.lit("fixed"))
    return new.unionByName(gone)


@query("j17", BASE + f"""SELECT site_id, coalesce(max_by(crawl_id, (finished_at, crawl_id)) FILTER (finished_at <= {_CNOW} - INTERVAL 60 DAY), min_by(crawl_id, (finished_at, crawl_id)) FILTER (finished_at > {_CNOW} - INTERVAL 60 DAY AND finished_at <= {_CNOW})) AS baseline
FROM crawls WHERE status = 'done' AND finished_at <= {_CNOW} GROUP BY 1""")
def j17(spark, sf_dir):
    """Baseline of a digest: the last crawl before the period, else the first inside it; one pass, no join."""
    edge = cnow() - F.expr("INTERVAL 60 DAY")
    at = F.struct("finished_at", "crawl_id")
    rows = crawls(spark, sf_dir).where("status = 'done'").where(F.col("finished_at") <= cnow())
    one = rows.groupBy("site_id").agg(F.max(F.when(F.col("finished_at") <= edge, at)).alias("before"), F.min(F.when(F.col("finished_at") > edge, at)).alias("inside"))
    return one.select("site_id", F.coalesce("before.crawl_id", "inside.crawl_id").alias("baseline"))


@query("j18", BASE + "SELECT crawl_id, lag(crawl_id) OVER (PARTITION BY site_id ORDER BY finished_at, crawl_id) AS previous FROM crawls WHERE status = 'done'")
def j18(spark, sf_dir):
    """The crawl that finished before each one."""
    w = Window.partitionBy("site_id").orderBy("finished_at", "crawl_id")
    return crawls(spark, sf_dir).where("status = 'done'").select("crawl_id", F.lag("crawl_id").over(w).alias("previous"))


@query("a26", "SELECT event_type AS kind, count(*) AS n, count(DISTINCT coalesce(json_extract_string(props, '$.k'), CAST(user_id AS VARCHAR))) AS subjects FROM events GROUP BY 1")
def a26(spark, sf_dir):
    """Funnel: events and distinct subjects per kind."""
    key = F.coalesce(F.get_json_object("props", "$.k"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.count_distinct(key).alias("subjects"))


@query("a27", BASE + "SELECT count(*) AS crawls, count(DISTINCT site_id) AS sites, CAST(sum(health_score) AS BIGINT) AS total FROM crawls")
def a27(spark, sf_dir):
    return crawls(spark, sf_dir).agg(F.count("*").alias("crawls"), F.count_distinct("site_id").alias("sites"), F.sum("health_score").alias("total"))


@query("a32", BASE + "SELECT site_id, kind, change_id FROM (SELECT *, row_number() OVER (PARTITION BY site_id, kind ORDER BY created_at DESC, change_id DESC) AS r FROM changes) WHERE r = 1")
def a32(spark, sf_dir):
    """The newest change of each site and kind, by partial maxima."""
    top = changes(spark, sf_dir).groupBy("site_id", "kind").agg(F.max(F.struct("created_at", "change_id")).alias("top"))
    return top.select("site_id", "kind", "top.change_id")


@query("a33", BASE + "SELECT site_id, bool_or(status = 'running') AS busy, max(created_at) + INTERVAL 7 DAY AS frees_at FROM crawls GROUP BY 1")
def a33(spark, sf_dir):
    return crawls(spark, sf_dir).groupBy("site_id").agg(F.bool_or(F.col("status") == "running").alias("busy"), (F.max("created_at") + F.expr("INTERVAL 7 DAY")).alias("frees_at"))


@query("t12", BASE + f"""SELECT crawl_id FROM crawls c WHERE status = 'failed' AND NOT EXISTS (SELECT 1 FROM crawls r WHERE r.site_id = c.site_id AND r.status = 'running' AND r.created_at >= TIMESTAMP '2001-07-30 00:00:00')
ORDER BY (health_score - date_diff('hour', created_at, {_CNOW})), crawl_id LIMIT 1""")
def t12(spark, sf_dir):
    """The next crawl to claim: priority less the hours waited, none of a site that runs one."""
    rows = crawls(spark, sf_dir)
    running = rows.where("status = 'running' AND created_at >= TIMESTAMP '2001-07-30 00:00:00'").select("site_id")
    waiting = rows.where("status = 'failed'").join(running, "site_id", "left_anti")
    waited = F.floor((F.unix_timestamp(cnow()) - F.unix_timestamp("created_at")) / 3600)
    return waiting.orderBy(F.col("health_score") - waited, "crawl_id").limit(1).select("crawl_id")


@query("t13", BASE + "SELECT site_id, due FROM (SELECT site_id, max(finished_at) FILTER (status = 'done' AND site_id % 4 <> 0) AS due FROM crawls GROUP BY 1) ORDER BY due NULLS FIRST, site_id LIMIT 100")
def t13(spark, sf_dir):
    """Sites that are due, those never crawled first."""
    due = F.max(F.when((F.col("status") == "done") & (F.col("site_id") % 4 != 0), F.col("finished_at"))).alias("due")
    return crawls(spark, sf_dir).groupBy("site_id").agg(due).orderBy(F.asc_nulls_first("due"), "site_id").limit(100)


@query("t14", BASE + f"SELECT change_id, severity, kind FROM changes WHERE created_at > {_NOW} - INTERVAL 7 DAY AND created_at <= {_NOW} ORDER BY {_RANK}, created_at DESC, change_id LIMIT 5")
def t14(spark, sf_dir):
    """The five top changes of the week."""
    week = changes(spark, sf_dir).where((F.col("created_at") > now() - F.expr("INTERVAL 7 DAY")) & (F.col("created_at") <= now()))
    return week.orderBy(F.expr(_RANK), F.desc("created_at"), "change_id").limit(5).select("change_id", "severity", "kind")


@query("s11", BASE + f"SELECT site_id, count(*) AS changes, count(*) FILTER (severity = 'critical') AS critical FROM changes WHERE created_at > {_NOW} - INTERVAL 7 DAY AND created_at <= {_NOW} GROUP BY 1")
def s11(spark, sf_dir):
    """Weekly digest: changes per site."""
    week = changes(spark, sf_dir).where((F.col("created_at") > now() - F.expr("INTERVAL 7 DAY")) & (F.col("created_at") <= now()))
    return week.groupBy("site_id").agg(F.count("*").alias("changes"), F.count_if(F.col("severity") == "critical").alias("critical"))


@query("s2", BASE + f"SELECT crawl_id, CASE WHEN crawl_id % 3 = 0 THEN 'fail' ELSE 'requeue' END AS action FROM crawls WHERE status = 'running' AND created_at < {_CNOW} - INTERVAL 45 SECOND")
def s2(spark, sf_dir):
    """Running crawls without a heartbeat: tried before, they fail, else they queue again."""
    stale = crawls(spark, sf_dir).where("status = 'running'").where(F.col("created_at") < cnow() - F.expr("INTERVAL 45 SECOND"))
    return stale.select("crawl_id", F.when(F.col("crawl_id") % 3 == 0, "fail").otherwise("requeue").alias("action"))


@query("s4", "SELECT user_id, CAST(CAST(ts AS TIMESTAMP) AS DATE) AS day, count(*) AS calls FROM events GROUP BY ALL")
def s4(spark, sf_dir):
    """Calls per key and day."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.window(F.col("ts").cast("timestamp"), "1 day").alias("w")).agg(F.count("*").alias("calls"))
    return rows.select("user_id", F.to_date("w.start").alias("day"), "calls")


@query("s3_offered", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(ts AS TIMESTAMP) RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS offered FROM events")
def s3_offered(spark, sf_dir):
    """Calls of a key within the hour up to each call."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return table(spark, sf_dir, "events").select("event_id", F.count("*").over(w).alias("offered"))


@query("s5", f"SELECT user_id, count(*) FILTER (CAST(ts AS TIMESTAMP) > {_NOW} - INTERVAL 1 HOUR) AS hour, count(*) AS day, min(CAST(ts AS TIMESTAMP)) + INTERVAL 1 DAY AS frees_at FROM events WHERE CAST(ts AS TIMESTAMP) > {_NOW} - INTERVAL 1 DAY AND CAST(ts AS TIMESTAMP) <= {_NOW} GROUP BY 1")
def s5(spark, sf_dir):
    """Rolling hour and day of each key, and when the day frees a call."""
    ts = F.col("ts").cast("timestamp")
    rows = table(spark, sf_dir, "events").where((ts > now() - F.expr("INTERVAL 1 DAY")) & (ts <= now()))
    return rows.groupBy("user_id").agg(F.count_if(ts > now() - F.expr("INTERVAL 1 HOUR")).alias("hour"), F.count("*").alias("day"), (F.min(ts) + F.expr("INTERVAL 1 DAY")).alias("frees_at"))


@query("s6", BASE + """SELECT a.change_id, max(b.change_id) AS reused FROM changes a JOIN changes b ON a.site_id = b.site_id AND a.kind = b.kind AND b.created_at < a.created_at AND b.created_at >= a.created_at - INTERVAL 2 HOUR GROUP BY 1""")
def s6(spark, sf_dir):
    """A request answered by an earlier one of the same key within two hours: the one with the largest id.

    A running maximum over a time range: one shuffle by key, no join of a key's rows with each other.
    """
    w = Window.partitionBy("site_id", "kind").orderBy(F.unix_micros("created_at")).rangeBetween(-7_200_000_000, -1)
    return changes(spark, sf_dir).select("change_id", F.max("change_id").over(w).alias("reused")).where("reused IS NOT NULL")


@query("s7", BASE + """, g AS (SELECT *, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY site_id ORDER BY created_at, change_id) <= INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS first FROM changes)
SELECT change_id FROM g WHERE first = 1""")
def s7(spark, sf_dir):
    """Deploy hooks that start a crawl: none came within five minutes before."""
    w = Window.partitionBy("site_id").orderBy("created_at", "change_id")
    gap = F.unix_micros("created_at") - F.lag(F.unix_micros("created_at")).over(w)
    return changes(spark, sf_dir).select("change_id", gap.alias("gap")).where("gap IS NULL OR gap > 300000000").select("change_id")


@query("s8", BASE + f"SELECT site_id, count(*) AS used, count(*) < 12 AS allowed, min(created_at) + INTERVAL 90 DAY AS frees_at FROM crawls WHERE created_at > {_CNOW} - INTERVAL 90 DAY AND created_at <= {_CNOW} GROUP BY 1")
def s8(spark, sf_dir):
    """Allowance in a sliding period; it frees when the oldest use drops out."""
    rows = crawls(spark, sf_dir).where((F.col("created_at") > cnow() - F.expr("INTERVAL 90 DAY")) & (F.col("created_at") <= cnow()))
    return rows.groupBy("site_id").agg(F.count("*").alias("used"), (F.count("*") < 12).alias("allowed"), (F.min("created_at") + F.expr("INTERVAL 90 DAY")).alias("frees_at"))


@query("s9", BASE + "SELECT crawl_id, CAST(power(2, crawl_id % 6) AS BIGINT) AS wait_minutes FROM crawls WHERE status = 'failed'")
def s9(spark, sf_dir):
    """Back-off of a job by its attempts."""
    return crawls(spark, sf_dir).where("status = 'failed'").select("crawl_id", F.pow(F.lit(2), F.col("crawl_id") % 6).cast("long").alias("wait_minutes"))


@query("s12", BASE + f"SELECT site_id, CASE WHEN last < {_CNOW} - INTERVAL 37 DAY THEN 'pause' WHEN last < {_CNOW} - INTERVAL 30 DAY THEN 'warn' ELSE 'active' END AS state FROM (SELECT site_id, max(created_at) FILTER (site_id % 3 <> 0 OR created_at < TIMESTAMP '2001-04-28 00:00:00') AS last FROM crawls WHERE created_at <= {_CNOW} GROUP BY 1)")
def s12(spark, sf_dir):
    """Inactive sites: warned after thirty days, paused a week later."""
    kept = F.when((F.col("site_id") % 3 != 0) | (F.col("created_at") < F.expr("TIMESTAMP '2001-04-28 00:00:00'")), F.col("created_at"))
    last = crawls(spark, sf_dir).where(F.col("created_at") <= cnow()).groupBy("site_id").agg(F.max(kept).alias("last"))
    return last.select("site_id", F.when(F.col("last") < cnow() - F.expr("INTERVAL 37 DAY"), "pause").when(F.col("last") < cnow() - F.expr("INTERVAL 30 DAY"), "warn").otherwise("active").alias("state"))


@query("s13", "SELECT e.user_id, min(e.event_id) AS event_id FROM events e WHERE e.event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.event_id < 300) GROUP BY 1")
def s13(spark, sf_dir):
    """Once per account: the first event of accounts that have none of the other kind."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    had = rows.where("event_type = 'purchase' AND event_id < 300").select("user_id").distinct()
    return rows.where("event_type = 'click'").join(had, "user_id", "left_anti").groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@query("j13", "SELECT DISTINCT user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'error' AND p.event_id < 3000)")
def j13(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return rows.select("user_id").distinct().join(rows.where("event_type = 'error' AND event_id < 3000").select("user_id").distinct(), "user_id", "left_anti")


@query("j14", BASE + "SELECT DISTINCT site_id FROM crawls c WHERE status = 'done' AND EXISTS (SELECT 1 FROM changes x WHERE x.site_id = c.site_id AND x.severity = 'critical')")
def j14(spark, sf_dir):
    loud = changes(spark, sf_dir).where("severity = 'critical'").select("site_id").distinct()
    return crawls(spark, sf_dir).where("status = 'done'").select("site_id").distinct().join(loud, "site_id", "left_semi")


@query("j16", BASE + "SELECT c.c_nationkey AS account, s.site_id, count(*) AS crawls FROM (SELECT DISTINCT site_id FROM changes) s JOIN crawls k USING (site_id) JOIN customer c ON c.c_custkey = s.site_id GROUP BY ALL")
def j16(spark, sf_dir):
    """Account, site and crawls; crawls are counted before they are joined."""
    sites = changes(spark, sf_dir).select("site_id").distinct()
    counted = crawls(spark, sf_dir).groupBy("site_id").agg(F.count("*").alias("crawls"))
    owner = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site_id"), F.col("c_nationkey").alias("account"))
    return sites.join(counted, "site_id").join(owner, "site_id").select("account", "site_id", "crawls")


@query("s14", BASE + f"""SELECT change_id FROM changes WHERE created_at >= {_NOW} - CASE WHEN site_id % 3 = 0 THEN INTERVAL 7 DAY ELSE INTERVAL 21 DAY END""")
def s14(spark, sf_dir):
    """Changes that a plan's history keeps."""
    days = F.when(F.col("site_id") % 3 == 0, F.expr("INTERVAL 7 DAY")).otherwise(F.expr("INTERVAL 21 DAY"))
    return changes(spark, sf_dir).where(F.col("created_at") >= now() - days).select("change_id")


@query("j15", BASE + "SELECT crawl_id FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY finished_at DESC, crawl_id DESC) AS r FROM crawls WHERE status = 'done') WHERE r <= 2")
def j15(spark, sf_dir):
    """What a deletion leaves: the newest two finished crawls of a site."""
    w = Window.partitionBy("site_id").orderBy(F.desc("finished_at"), F.desc("crawl_id"))
    return crawls(spark, sf_dir).where("status = 'done'").withColumn("r", F.row_number().over(w)).where("r <= 2").select("crawl_id")


_DEFAULT_KINDS = "'status_changed', 'error_spike', 'became_noindex'"


@query("s16", BASE + f"SELECT change_id, channel FROM changes JOIN (VALUES ('mail', 2), ('chat', 1), ('hook', 0)) ch(channel, least) ON {_RANK} <= ch.least WHERE kind IN ({_DEFAULT_KINDS}) AND (kind <> 'became_noindex' OR site_id % 2 = 0)")
def s16(spark, sf_dir):
    """Alerts: changes of instant kinds, by the channels whose least severity they reach."""
    channels = spark.createDataFrame([("mail", 2), ("chat", 1), ("hook", 0)], "channel string, least int")  # one row per channel
    rows = changes(spark, sf_dir).where(f"kind IN ({_DEFAULT_KINDS}) AND (kind <> 'became_noindex' OR site_id % 2 = 0)").withColumn("rank", F.expr(_RANK))
    return rows.join(F.broadcast(channels), F.col("rank") <= F.col("least")).select("change_id", "channel")


@query("s18", """, r AS (SELECT 1) SELECT 1""".replace(", r AS (SELECT 1) SELECT 1", """WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS TIMESTAMP), event_id) AS i FROM events),
g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, event_type IN ('error', 'click') ORDER BY i) AS island FROM e)
SELECT user_id, max(n) AS longest FROM (SELECT user_id, island, count(*) AS n FROM g WHERE event_type IN ('error', 'click') GROUP BY ALL) GROUP BY 1 HAVING max(n) >= 4"""))
def s18(spark, sf_dir):
    """Runs of failures: the longest run of a key, from four on."""
    order = Window.partitionBy("user_id").orderBy(F.col("ts").cast("timestamp"), "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").isin("error", "click").alias("bad"), F.row_number().over(order).alias("i"))
    island = F.col("i") - F.row_number().over(Window.partitionBy("user_id", "bad").orderBy("i"))
    runs = rows.withColumn("island", island).where("bad").groupBy("user_id", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("user_id").agg(F.max("n").alias("longest")).where("longest >= 4")


@query("t11", BASE + f"SELECT change_id, row_number() OVER (ORDER BY {_RANK}, created_at, change_id) AS place FROM changes WHERE kind = 'error_spike' AND site_id = 5")
def t11(spark, sf_dir):
    """Open incidents of a site in their order."""
    rows = changes(spark, sf_dir).where("kind = 'error_spike' AND site_id = 5")
    return rows.select("change_id", F.row_number().over(Window.orderBy(F.expr(_RANK), "created_at", "change_id")).cast("long").alias("place"))


@query("snk6", BASE + f"SELECT change_id, kind, resolved_at IS NULL AS open FROM (SELECT *, CASE WHEN change_id % 3 = 0 THEN created_at + INTERVAL 2 DAY END AS resolved_at FROM changes) WHERE resolved_at IS NULL OR resolved_at >= {_NOW} - INTERVAL 9 DAY")
def snk6(spark, sf_dir):
    """Incident export: open ones, and those resolved lately."""
    rows = changes(spark, sf_dir).withColumn("resolved_at", F.when(F.col("change_id") % 3 == 0, F.col("created_at") + F.expr("INTERVAL 2 DAY")))
    return rows.where(F.col("resolved_at").isNull() | (F.col("resolved_at") >= now() - F.expr("INTERVAL 9 DAY"))).select("change_id", "kind", F.col("resolved_at").isNull().alias("open"))


@query("a28", BASE + "SELECT count(*) AS incidents, count(*) FILTER (severity = 'critical') AS critical FROM changes WHERE change_id % 3 <> 0")
def a28(spark, sf_dir):
    return changes(spark, sf_dir).where("change_id % 3 <> 0").agg(F.count("*").alias("incidents"), F.count_if(F.col("severity") == "critical").alias("critical"))


@query("v11", BASE + "SELECT site_id, arg_max(crawl_id, (finished_at, crawl_id)) AS crawl_id, arg_max(health_score, (finished_at, crawl_id)) AS health_score FROM crawls WHERE status = 'done' GROUP BY 1")
def v11(spark, sf_dir):
    """Sites with their latest crawl and score."""
    top = crawls(spark, sf_dir).where("status = 'done'").groupBy("site_id").agg(F.max(F.struct("finished_at", "crawl_id", "health_score")).alias("top"))
    return top.select("site_id", "top.crawl_id", "top.health_score")
