"""What the operators of this folder share: checkpoints, words, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagewright.session import checkpoint_folder

#: The setting by which Spark drops the shuffle files of a finished execution.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A word is a run of anything but ASCII white space; bytes.split() of the UTF-8 text cuts at the same places.
WORD = r"[^\x20\x09-\x0D]+"


#: Folders made inside of scratch(), innermost last.
_made: list[list[str]] = []


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder as Parquet and read again, so that its lineage and whatever the
    optimiser has inferred about its columns end here. (DataFrame.checkpoint keeps the inferred constraints, which grow
    from round to round in loops.) The shuffle files of the write go when it is done. The folder stays as long as the
    cluster keeps it, or until the end of the scratch() around it."""
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark)}/pagewright-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(folder)
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(_FREE_SHUFFLES, before) if before is not None else spark.conf.unset(_FREE_SHUFFLES)
    return spark.read.schema(df.schema).parquet(folder)


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new name below the shared checkpoint folder, for files that a result is read from later."""
    return f"{checkpoint_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is checkpointed inside is deleted at the end; results that read it have to be written before."""
    _made.append([])
    try:
        yield
    finally:
        for folder in _made.pop():
            delete(spark, folder)


def named(column: str) -> Column:
    """The column of exactly this name, whatever characters (dots, spaces, backticks) the name holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def boxed(df: DataFrame, keep: list[str] | None = None, **more: Column) -> DataFrame:
    """df's rows (or their columns in keep) as one struct column, box, beside the columns in more: an operator's own
    columns then never meet a name of the caller. select("box.*") gives the rows back as they were."""
    box = F.struct("*") if keep is None else F.struct(*map(named, keep))
    return df.select(box.alias("box"), *(c.alias(name) for name, c in more.items()))


def with_columns(boxes: DataFrame, ddl: str) -> StructType:
    """The schema of boxes' box followed by the columns of ddl."""
    return StructType([boxes.schema["box"], *StructType.fromDDL(ddl).fields])


def column_of(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def held_out(doc_id: Column, divisor: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves the remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor == remainder


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches of up to size rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers (two multiply-xorshift rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class WordHashes(dict):
    """Word -> unsigned 64-bit hash, remembered; forgets everything when it holds too many words."""

    def __init__(self, most: int = 400_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
