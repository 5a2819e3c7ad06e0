"""Texts of answers: decoding of bytes, and how wide a line is set and where it is cut."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagewright.functions.charset import decoded
from pagewright.functions.dims import ADVANCES, CAPITAL, OTHER, UNITS, WIDE


def decoded_bodies(answers: DataFrame, key: str, body: str, content_type: str) -> DataFrame:
    """key, charset, text of answers' bodies (bytes); a null body has neither."""
    picked = answers.select(F.col(key).alias("key"), F.col(body).alias("body"), F.col(content_type).alias("type"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [(None, None) if b is None else decoded(b, t) for b, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[c] for r in rows], pa.string()) for c in range(2))], names=["key", "charset", "text"])

    return picked.mapInArrow(run, StructType([picked.schema["key"], *StructType.fromDDL("charset string, text string").fields])).withColumnRenamed("key", key)


def characters(text: Column) -> Column:
    """The code points of a text."""
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def advance(character: Column) -> Column:
    """How wide a character is set, in units."""
    known = F.create_map(*(F.lit(x) for units, chars in ADVANCES for c in chars for x in (c, units)))
    rest = F.when(character.rlike(WIDE), UNITS).when(character.rlike(r"\p{Lu}"), CAPITAL).otherwise(OTHER)
    return F.coalesce(F.try_element_at(known, character), rest)


def _pixels(units: Column, size: int) -> Column:
    return F.floor((units * size + UNITS // 2) / UNITS).cast("int")


def width(text: Column, size: int) -> Column:
    """Pixels of a text set in a size; null is null."""
    return _pixels(F.aggregate(characters(text), F.lit(0).cast("long"), lambda s, c: s + advance(c)), size)


def fitted(text: Column, limit: int, size: int) -> Column:
    """The text, trimmed, if it is set in at most limit pixels; else its longest beginning that is so with an ellipsis behind
    it, cut at a blank where that keeps two thirds of its bytes. Texts that not even an ellipsis fits are empty. Characters are
    never cut in two."""
    whole = F.trim(text)
    ellipsis = " …"
    # Beginnings without blanks at their end: at each character, units and length up to the last that is no blank.
    start = F.struct(F.lit(0).cast("long").alias("all"), F.lit(0).cast("long").alias("units"), F.lit(0).alias("n"), F.lit(0).alias("length"), F.lit(False).alias("over"))
    room = lambda units: _pixels(units + sum(_units_of(c) for c in ellipsis), size) <= limit

    def step(s: Column, c: Column) -> Column:
        all_units, n, blank = s["all"] + advance(c), s["n"] + 1, c.rlike(r"^\s$")
        fits = ~s["over"] & (blank | room(all_units))
        return F.struct(
            all_units.alias("all"), F.when(fits & ~blank, all_units).otherwise(s["units"]).alias("units"), n.alias("n"),
            F.when(fits & ~blank, n).otherwise(s["length"]).alias("length"), (~fits).alias("over"),
        )

    kept = F.aggregate(characters(whole), start, step)["length"]
    cut = F.substring(whole, F.lit(1), kept)
    at_blank = F.regexp_extract(cut, r"(?s)^(.*)\s", 1)
    word = (F.instr(F.reverse(cut), " ") > 0) & (F.octet_length(at_blank) >= F.floor(F.octet_length(cut) * 2 / 3))
    shortened = F.concat(F.when(word, F.rtrim(at_blank)).otherwise(cut), F.lit(ellipsis))
    return F.when(width(whole, size) <= limit, whole).when(room(F.lit(0).cast("long")), shortened).otherwise("")


def _units_of(character: str) -> int:
    return next((units for units, chars in ADVANCES if character in chars), OTHER)
