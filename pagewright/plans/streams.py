"""Streaming queries over the event files: each reads them as a stream and runs to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.dims import BITS, CHECKS
from pagewright.operators import checks as C
from pagewright.plans.audit import _DIM, FAILED
from pagewright.plans.fixtures import narrow, table
from pagewright.plans.registry import query
from pagewright.session import checkpoint_folder
from pagewright.streaming import incidents
from pagewright.streaming import state as S


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, with event time."""
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def to_the_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The rows that a stream writes until its input is used up, as a table in the shared checkpoint folder."""
    folder = f"{checkpoint_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    run = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


@query("s1", "SELECT DISTINCT user_id, event_type FROM events")
def s1(spark, sf_dir):
    """First rows of each key: duplicates within the watermark are dropped as they come."""
    stream = S.deduplicated(events_stream(spark, sf_dir), ["user_id", "event_type"], late="60 days")
    return to_the_end(stream.select("user_id", "event_type"))


@query("s19", "SELECT user_id, start, count(*) AS n FROM (SELECT user_id, date_trunc('day', CAST(ts AS TIMESTAMP)) AS start FROM events) WHERE start + INTERVAL 1 DAY <= (SELECT max(CAST(ts AS TIMESTAMP)) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2")
def s19(spark, sf_dir):
    """Running tally of each key and day, final once the watermark passes."""
    rows = to_the_end(S.tallied(events_stream(spark, sf_dir), "user_id"))
    return rows.select("user_id", "start", "n")


@query("s3")
def s3(spark, sf_dir):
    """Accepted and refused calls of each key, two within six hours; the tests hold the fold against a plain one."""
    return to_the_end(S.admission(events_stream(spark, sf_dir), "user_id", most=2, span_seconds=6 * 3600))


@query("s15")
def s15(spark, sf_dir):
    """Incidents by key from a stream of judgements: errors are findings, purchases judge a key clean."""
    rank = F.when(F.col("event_type") == "error", F.col("event_id") % 3).when(F.col("event_type") != "purchase", F.lit(9))
    judged = events_stream(spark, sf_dir).where("event_type IN ('error', 'purchase')").withColumn("rank", rank)
    return to_the_end(S.incidents(judged.select("user_id", "ts", "rank"), ["user_id"]))


@query("s15_machine")
def s15_machine(spark, sf_dir):
    """Incidents by user with snoozes, acceptances and quiet first findings; all that is due by time runs as timers. The
    tests hold the stream against a plain fold."""
    action = F.when(F.col("event_type").isin("error", "view"), "finding").when(F.col("event_type") == "purchase", "clean").when(F.col("event_type") == "signup", "snooze").otherwise("accept")
    rank = F.when(F.col("event_type") == "error", F.col("event_id") % 3).when(F.col("event_type") == "view", F.lit(3)).cast("int")
    events = events_stream(spark, sf_dir).select("user_id", "ts", action.alias("action"), rank.alias("rank"), (F.col("ts") + F.expr("INTERVAL 3 DAYS")).alias("until"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return to_the_end(incidents.machine(events, ["user_id"]))
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)


def last_state(stream: DataFrame) -> DataFrame:
    """What an aggregate over a stream says once its input is used up; each batch's whole state replaces the one before."""
    folder = f"{checkpoint_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"

    def keep(rows: DataFrame, _: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out")

    run = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


_TALLIED = FAILED + ", own AS (SELECT page_id, bit FROM failed WHERE bit IN (" + ", ".join(str(bit) for bit, _, _, scope in CHECKS if scope == "page" and bit < BITS["policy_address"]) + "))"


@query("a31", _TALLIED + _DIM + " SELECT 'pages' AS name, count(*) AS n FROM cur UNION ALL SELECT 'with_issues', count(DISTINCT page_id) FROM own UNION ALL SELECT d.slug, count(*) FROM own JOIN dim d USING (bit) GROUP BY 1")
def a31(spark, sf_dir):
    """A live crawl's tally: the pages stream in, counts of checks grow."""
    pages = narrow(spark, sf_dir)
    folder = f"{checkpoint_folder(spark)}/live-{uuid.uuid4().hex}"
    pages.repartition(4).write.parquet(folder)
    rows = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    return last_state(S.live_tally(rows, C.page_checks()))
