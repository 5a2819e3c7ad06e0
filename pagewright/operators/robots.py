"""Robots rules as rows: states of a fetch, rules of many files, verdicts for many paths."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagewright.functions.robots import Group, Rule, Verdicts, groups_of, rules_for

#: Paths of one file that a task judges at once; files with more paths are dealt into slices.
SLICE = 20_000

RULES_DDL = "group_idx int, agents array<string>, line int, allow boolean, pattern string, length int"


def fetch_state(status: Column, crawler: bool) -> Column:
    """What an answer means; the crawler takes a last redirect for a block, the access report for no file."""
    blocked = (status == 429) | (status >= 500) | (status == 0)
    return F.when(status.between(200, 299), "parsed").when(blocked, "all_blocked").when(status.between(400, 499), "no_rules").otherwise("blocked" if crawler else "no_rules")


def parsed(files: DataFrame, by: list[str], body: str = "body") -> DataFrame:
    """by, group_idx, agents, line, allow, pattern, length: the rules of a table of robots files (texts or bytes).

    A group without rules, which frees its agents, has one row without line and pattern. Null and empty files have none.
    A file is read up to its first 500 KiB, so a row's rules are bounded.
    """
    picked = files.select(*by, F.col(body).alias("body"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for k, text in enumerate(part.column(len(by)).to_pylist()):
                for g, group in enumerate(groups_of(text), 1):
                    agents = sorted(set(group.agents))
                    rows += [(k, g, agents, *r) for r in group.rules] or [(k, g, agents, None, None, None, None)]
            if not rows:
                continue
            at, *columns = zip(*rows)
            types = [pa.int32(), pa.list_(pa.string()), pa.int32(), pa.bool_(), pa.string(), pa.int32()]
            kept = [part.column(c).take(pa.array(at)) for c in range(len(by))]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, columns, types)], names=[*by, "group_idx", "agents", "line", "allow", "pattern", "length"])

    schema = StructType([*(picked.schema[c] for c in by), *StructType.fromDDL(RULES_DDL).fields])
    return picked.mapInArrow(run, schema)


def _groups(table: pa.Table) -> list[Group]:
    groups: dict[int, Group] = {}
    for row in sorted(table.to_pylist(), key=lambda r: (r["group_idx"], r["line"] or 0)):
        group = groups.setdefault(row["group_idx"], Group(row["agents"], []))
        if row["pattern"] is not None:
            group.rules.append(Rule(row["line"], row["allow"], row["pattern"], row["length"]))
    return list(groups.values())


def verdicts(paths: DataFrame, tokens: list[str], rules: DataFrame, paths_id: str = "page_id", by: list[str] | None = None, fallback: dict[str, str] | None = None) -> DataFrame:
    """paths_id, token, allowed, line: the rule that decides each path for each token, and what it says.

    rules: rows of parsed(), with the columns in by (a host, say) that tell whose file they are of. fallback: tokens whose
    agents follow another one's groups where none names them. Paths without a file, and null paths, are allowed.

    A file's rules meet its paths in slices of about `SLICE` paths, however many paths a file has; rules (500 KiB at
    most) are copied once a slice, not once a path.
    """
    by, others = by or [], fallback or {}
    key = F.to_json(F.struct(*by)) if by else F.lit("")
    rows = paths.select(key.alias("key"), F.col(paths_id).alias("id"), "path", F.monotonically_increasing_id().alias("at"))
    large = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices")).where("slices > 1")
    slices = F.coalesce("slices", F.lit(1))
    rows = rows.join(large, "key", "left").select("key", F.pmod("at", slices).cast("int").alias("slice"), "id", "path")
    held = rules.select(key.alias("key"), "group_idx", "agents", "line", "allow", "pattern", "length").join(large, "key", "left")
    held = held.select("key", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), "group_idx", "agents", "line", "allow", "pattern", "length")
    out = StructType([paths.select(F.col(paths_id).alias("id")).schema["id"], *StructType.fromDDL("token string, allowed boolean, line int").fields])

    def judge(own: pa.Table, file: pa.Table) -> pa.Table:
        groups = _groups(file)
        sets: dict[tuple[Rule, ...], Verdicts] = {}  # agents of one group share their rules
        columns: tuple[list, ...] = ([], [], [])
        asked = own.column("path").to_pylist()
        for token in tokens:
            chosen = tuple(rules_for(groups, token, others.get(token)))
            if chosen not in sets:
                sets[chosen] = Verdicts(list(chosen))
            judged = sets[chosen]
            found = [judged.rule(p) if p is not None else None for p in asked]
            columns[0].extend([token] * len(asked))
            columns[1].extend(r is None or r.allow for r in found)
            columns[2].extend(r and r.line for r in found)
        ids = pa.concat_arrays([c for _ in tokens for c in own.column("id").chunks]) if len(asked) else own.column("id").combine_chunks()
        return pa.table([ids, pa.array(columns[0], pa.string()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.int32())], names=out.names)

    both = rows.groupBy("key", "slice").cogroup(held.groupBy("key", "slice"))
    return both.applyInArrow(judge, out).withColumnRenamed("id", paths_id)
