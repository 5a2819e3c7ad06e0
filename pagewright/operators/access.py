"""Access of bots and answer engines: directives, effects, stances, verdicts, scores, incidents, policies."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagewright.functions.challenges import SCANNED, Detector
from pagewright.functions.dims import ENGINES
from pagewright.operators.explore import glob_regex

#: Directives that carry a value; their name is no agent.
VALUE_DIRECTIVES = ("max-snippet", "max-image-preview", "max-video-preview", "unavailable_after")


def directives(value: Column, scopes: list[str]) -> Column:
    """The directives of a comma list that apply under scopes. `agent:` sets the scope of what follows it."""
    words = F.filter(F.transform(F.split(F.lower(F.coalesce(value, F.lit(""))), ","), lambda w: F.trim(w)), lambda w: w != "")
    start = F.struct(F.lit(True).alias("applies"), F.array().cast("array<string>").alias("out"))

    def step(held: Column, word: Column) -> Column:
        head = F.trim(F.split_part(word, F.lit(":"), F.lit(1)))
        scoped = word.contains(":") & ~head.isin(*VALUE_DIRECTIVES)
        applies = F.when(scoped, head.isin(*scopes) if scopes else F.lit(False)).otherwise(held["applies"])
        rest = F.when(scoped, F.trim(F.regexp_replace(word, "^[^:]*:", ""))).otherwise(word)
        return F.struct(applies.alias("applies"), F.when(applies & (rest != ""), F.concat(held["out"], F.array(rest))).otherwise(held["out"]).alias("out"))

    return F.aggregate(words, start, step)["out"]


def effects(pages: DataFrame) -> DataFrame:
    """page_id, engine, rank, effect of every html page: 2 excluded, 1 limited, 0 eligible; one pass, no join."""
    made = []
    words = F.col("__words")
    for engine, _, excluded, limited, max_snippet, share in ENGINES:
        rank = F.lit(0)
        if excluded:
            rank = F.greatest(rank, F.when(F.arrays_overlap(words, F.array(*map(F.lit, excluded))), 2).otherwise(0))
        if limited:
            rank = F.greatest(rank, F.when(F.arrays_overlap(words, F.array(*map(F.lit, limited))), 1).otherwise(0))
        if max_snippet:
            any_ = F.exists(words, lambda w: w.startswith("max-snippet:"))
            rank = F.greatest(rank, F.when(F.array_contains(words, "max-snippet:0"), 2).when(any_, 1).otherwise(0))
        if share:
            hidden = F.col("nosnippet_words")
            rank = F.greatest(rank, F.when((hidden > 0) & (hidden * 100 >= 25 * F.greatest("word_count", hidden)), 1).otherwise(0))
        made.append(F.struct(F.lit(engine).alias("engine"), rank.alias("rank")))
    rows = pages.where("html_ok").select("page_id", "word_count", "nosnippet_words", directives(F.col("meta_robots"), []).alias("__words"))
    rows = rows.select("page_id", F.explode(F.array(*made)).alias("e")).select("page_id", "e.engine", "e.rank")
    return rows.withColumn("effect", F.expr("CASE rank WHEN 2 THEN 'excluded' WHEN 1 THEN 'limited' ELSE 'eligible' END"))


def restricted(effects_: DataFrame, root: int = 0) -> DataFrame:
    """engine, severity of the engines that lose pages."""
    rows = effects_.groupBy("engine").agg(
        F.count_if(F.col("rank") == 2).alias("excluded"), F.count_if(F.col("rank") == 1).alias("limited"), F.count("*").alias("pages"),
        F.bool_or((F.col("page_id") == root) & (F.col("rank") == 2)).alias("home"),
    )
    severity = F.when(F.col("home") | (2 * F.col("excluded") >= F.col("pages")), "critical").when(F.col("excluded") > 0, "warning").otherwise("notice")
    return rows.where("excluded + limited > 0").withColumn("severity", severity)


def stances(spark: SparkSession, bots: DataFrame, purposes: dict[str, str], overrides: dict[str, str]) -> DataFrame:
    """token, stance: the bot's own rule in any case, else its purpose's, else the default of its purpose."""
    default = {"search": "allow", "user_fetch": "allow"} | purposes
    by_purpose = spark.createDataFrame(list(default.items()), "purpose string, by_purpose string")
    own = spark.createDataFrame([(k.lower(), v) for k, v in overrides.items()] or [("", "")], "low string, own string")
    rows = bots.select("token", "purpose", F.lower("token").alias("low")).join(F.broadcast(own), "low", "left").join(F.broadcast(by_purpose), "purpose", "left")
    return rows.select("token", F.coalesce("own", "by_purpose", F.lit("any")).alias("stance"))


def content_state(html_ok: Column, words: Column, mount_empty: Column, notice: Column, has_h1: Column, mount: Column, scripted: Column, links: Column) -> Column:
    """What a page holds for a reader that runs no scripts."""
    return (
        F.when(~html_ok | (words >= 50), "present")
        .when(mount_empty | (notice & ~has_h1 & (mount | scripted)), "shell")
        .when(~has_h1 & ~links & scripted, "likely_shell")
        .otherwise("thin")
    )


def probe_verdict() -> Column:
    """What a bot's fetch was against the browser's, by the first rule that holds."""
    c = F.col
    return (
        F.when(c("base_challenge") | ~c("base_status").between(200, 299), "inconclusive")
        .when((c("status") == 0) & c("dropped"), "blocked")
        .when(c("status") == 0, "inconclusive")
        .when(c("challenge"), "challenged")
        .when(c("status") == 429, "throttled")
        .when(c("status") >= 400, "blocked")
        .when(c("final") != c("url"), "diverted")
        .when((c("bot_title") != c("base_title")) & ((c("words") * 2 < c("word_count")) | (c("bot_title") == "")), "degraded")
        .otherwise("same")
    )


def geo_losses(checks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Checks that were judged, with the points each loses; a skipped check leaves both sides."""
    rows = checks.join(F.broadcast(outcomes), "name", "left").where(~F.coalesce("skipped", F.lit(False)))
    loss = F.least(F.col("cap") * (0.25 + 0.75 * F.col("share").cast("double")), F.col("weight").cast("double"))
    return rows.withColumn("loss", F.when(F.col("cap").isNull(), 0.0).otherwise(loss))


def geo_score(checks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """geo_score: two tiers by their points; an empty tier's points go to the other."""
    tiers = geo_losses(checks, outcomes).groupBy("tier").agg((F.sum("loss") / F.sum("weight")).alias("share"))
    return tiers.agg(F.round(100 - F.sum(F.col("share") * F.col("tier")) * 100 / F.sum("tier")).cast("int").alias("geo_score"))


def reconciled(found: DataFrame, held: DataFrame, judged: Column) -> DataFrame:
    """kind, subject, step, escalated, widened: findings joined with open incidents; unjudged kinds are not resolved."""
    f = found.select("kind", "subject", F.col("rank").alias("f_rank"), F.col("members").alias("f_members"), F.lit(True).alias("f"))
    i = held.select("kind", "subject", F.col("rank").alias("i_rank"), F.col("members").alias("i_members"), F.lit(True).alias("i"))
    rows = f.join(i, ["kind", "subject"], "full")
    step = F.when(F.col("i").isNull(), "opened").when(F.col("f").isNull(), "resolved").otherwise("updated")
    no = F.lit(False)
    rows = rows.select("kind", "subject", step.alias("step"), F.coalesce(F.col("f_rank") < F.col("i_rank"), no).alias("escalated"), F.coalesce(F.col("f_members") > F.col("i_members"), no).alias("widened"))
    return rows.where((F.col("step") != "resolved") | judged)


def first_rule(pages: DataFrame, rules: list[tuple], out: str = "stance") -> DataFrame:
    """pages and the value of the first rule (glob, value) that the path meets; rules are a policy's few dozen."""
    return pages.withColumn(out, F.coalesce(*(F.when(F.col("path").rlike(glob_regex(g)), F.lit(v)) for g, v in rules)))


def address_gap(scheme: str, www: bool, slash: bool) -> Column:
    """The first way in which a page is not at its preferred address."""
    last = F.col("path").endswith("/")
    return (
        F.when(~F.col("url").startswith(scheme + "://"), "scheme")
        .when(F.col("host").startswith("www.") != F.lit(www), "host")
        .when((F.col("path") != "/") & (last != F.lit(slash)), "slash")
    )


def challenges(answers: DataFrame, key: str, status: str, headers: str, body: str, scanned: int | None = SCANNED) -> DataFrame:
    """key, vendor, signal of the answers (status, map of headers, text or bytes of the body) that are a bot manager's
    challenge or refusal. Null headers and bodies are empty ones; of a body the first `scanned` bytes are searched (None:
    all); the automaton is made once a task."""
    picked = answers.select(F.col(key).alias("key"), F.col(status).cast("int").alias("status"), F.map_entries(headers).alias("headers"), F.col(body).cast("binary").alias("body"))
    schema = StructType([picked.schema["key"], *StructType.fromDDL("vendor string, signal string").fields])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector()
        for part in parts:
            rows = [detector.found(s, [(h["key"], h["value"]) for h in hs or ()], b, scanned) for s, hs, b in zip(*(c.to_pylist() for c in part.columns[1:]))]
            hit = pa.array([k for k, r in enumerate(rows) if r], pa.int32())
            columns = [pa.array([r[c] for r in rows if r], pa.string()) for c in range(2)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(hit), *columns], names=schema.names)

    return picked.mapInArrow(run, schema).withColumnRenamed("key", key)
