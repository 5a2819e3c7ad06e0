"""Differences of texts by lines and of JSON documents by keys, and robots files as a policy wants them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagewright.functions.lines import line_diff
from pagewright.functions.robots_edit import Intent, suggested
from pagewright.session import cut_lineage


def _each(df: DataFrame, keys: list[str], ddl: str, rows_of) -> DataFrame:
    """keys and, for each row that rows_of gives for the values behind them, the columns of ddl."""
    more = StructType.fromDDL(ddl)
    schema = StructType([*(df.schema[k] for k in keys), *more.fields])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in more.fields]
        for part in parts:
            values = zip(*(c.to_pylist() for c in part.columns[len(keys) :]))
            rows = [(k, *row) for k, v in enumerate(values) for row in rows_of(*v)]
            if rows:
                at, *columns = zip(*rows)
                kept = [part.column(c).take(pa.array(at)) for c in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, columns, types)], names=schema.names)

    return df.mapInArrow(run, schema)


def line_diffs(pairs: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """keys, place, sign, line: a shortest difference of two texts of a row, line by line; ends of lines and blanks at
    either end of a line do not count, null is the empty text."""

    def rows_of(old: str | None, new: str | None) -> list[tuple]:
        have, want = ([x.strip() for x in t.split("\n")] if t else [] for t in (old, new))
        return [(n, sign, line) for n, (sign, line) in enumerate(line_diff(have, want), 1)]

    return _each(pairs.select(*keys, before, after), keys, "place int, sign string, line string", rows_of)


def suggestions(files: DataFrame, keys: list[str], intent: Intent, body: str = "body") -> DataFrame:
    """keys, suggested, added, removed: each robots file as the policy wants it, and what it takes in lines. A null file
    is a site without one."""

    def rows_of(text: str | None) -> list[tuple]:
        new = suggested(text, intent)
        have = [x.strip() for x in (text or "").split("\n")]
        signs = [sign for sign, _ in line_diff(have, new.rstrip("\n").split("\n"))]
        return [(new, signs.count("+"), signs.count("-"))]

    return _each(files.select(*keys, body), keys, "suggested string, added int, removed int", rows_of)


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def changed_keys(pairs: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """keys, path, before, after: the dotted paths at which two JSON texts of a row differ, with the values as JSON (null:
    there is none, which is told apart from JSON's own null).

    Objects are compared key by key, at any depth, also where only one side has one; arrays and all else as wholes. A round
    takes all documents one level down, each row by itself: no row is moved. A text that is null or no JSON is an absent
    document. keys are unique and not null.
    """
    out = None
    level = pairs.select(*keys, F.lit("").alias("path"), F.try_parse_json(before).alias("a"), F.try_parse_json(after).alias("b"))
    members = "map<string, variant>"
    while True:
        down = (_is_object(F.col("a")) | F.col("a").isNull()) & (_is_object(F.col("b")) | F.col("b").isNull()) & (F.col("a").isNotNull() | F.col("b").isNotNull())
        level = cut_lineage(level.select(*keys, "path", "a", "b", down.alias("down")))
        values = level.where("NOT down").select(*keys, "path", F.to_json("a").alias("before"), F.to_json("b").alias("after"))
        values = values.where(~F.col("before").eqNullSafe(F.col("after")))
        out = values if out is None else out.unionByName(values)
        going = level.where("down")
        if going.isEmpty():
            return out
        # A reader of files may get the members of all rows before it drops those that do not go on, so what is no object is null.
        held = going.select(*keys, "path", *(F.coalesce(F.try_variant_get(c, "$", members), F.create_map().cast(members)).alias(c) for c in "ab"))
        names = held.select(*keys, "path", "a", "b", F.explode(F.array_union(F.map_keys("a"), F.map_keys("b"))).alias("name"))
        inner = F.when(F.col("path") == "", F.col("name")).otherwise(F.concat_ws(".", "path", "name"))
        level = names.select(*keys, inner.alias("path"), F.try_element_at("a", F.col("name")).alias("a"), F.try_element_at("b", F.col("name")).alias("b"))
