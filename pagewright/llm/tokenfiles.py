"""Token ids of a corpus as files of directly addressable codes.

A sequence of whole numbers is cut into levels. Level 1 holds the lowest bits of every number; a bitmap says which
numbers have more, and level 2 holds the next bits of those alone, in the same order, and so on. The place of a number
in the next level is its rank in the bitmap, read from a directory of counts (one for every 512 bits) and at most 512
bits behind it. So any number, or any run of them, is read by itself; no block is ever decoded. The widths of the levels
are fitted to each segment: of all ways to cut 32 bits, that with the fewest bits for the segment's numbers.

Documents are dealt by ranges of ascending id; each task encodes its range and writes segments of whole documents, closed
at `SEGMENT` ids or more (a longer document has a segment of its own). A segment is self-contained: ids, the numbers of
ids of its documents (directly addressable too) and the documents' own ids. A folder holds

    segments  Parquet: file, segment, first (ids before it in its file), n_tokens, n_docs, data (the segment's bytes)
    index     Parquet: file, first (ids of all files before it), n_tokens; one row a file

Parquet is only the box: it can be written to any store that Spark reaches, and its commit keeps what a lost executor
left half-written out of sight. `file` is the range's number, so that files are in ascending order of documents.

Defined results: null text is the empty text and has the end id only; a null document id comes first; rows of equal id
stand in the order of their text's hash, repeated rows are written as often as they stand; an empty table gives a folder
without segments. Columns other than id and text are not read. A marker of a special token in a text has that token's id.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.common import batches, column_of, named
from pagewright.llm.packing import Ids

SEGMENT = 1 << 18
#: Bits of a bitmap for each entry of its rank directory.
RANK_BITS = 512
#: More levels save a few bits of a number and cost time to read.
MOST_LEVELS = 3
MAGIC = b"DAC1"
#: Documents are read in runs of at least this many ids.
RUN = 1 << 14

SEGMENTS = pa.schema([("file", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("n_docs", pa.int64()), ("data", pa.binary())])
SEGMENTS_DDL = "file int, segment int, first long, n_tokens long, n_docs long, data binary"
DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("file", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
DOCUMENTS_DDL = "doc_id long, file int, first long, n_tokens long, ids_crc32 long"
#: Positions are joined with segments by stretches of this many ids (a power of two).
STRETCH_BITS = 18


def fitted_widths(values: np.ndarray, most_levels: int = MOST_LEVELS) -> list[int]:
    """The widths of at most most_levels levels that store the numbers in the fewest bits. A number of b bits has an entry
    in each level that begins below bit b; an entry costs the level's width, and a bit of the bitmap in all levels but the last."""
    top = max(1, int(values.max(initial=0)).bit_length())
    longer = [len(values), *(int(np.count_nonzero(values >= 1 << b)) for b in range(1, top + 1))]  # numbers that go on after bit b
    # best[end]: bits and widths of the levels up to bit end, with one level more in each round.
    best: dict[int, tuple[int, list[int]]] = {0: (0, [])}
    for _ in range(most_levels):
        ways = [(end, best[a][0] + longer[a] * (end - a + (end < top)), [*best[a][1], end - a]) for a in best for end in range(a + 1, top + 1)]
        for end, bits, widths in ways:
            best[end] = min(best.get(end, (bits, widths)), (bits, widths))
    return best[top][1]


def _packed(values: np.ndarray, width: int) -> bytes:
    """Numbers of width bits each, least bit first, and 8 zero bytes so that every number can be read as part of 64 bits.
    Eight numbers fill width bytes, so each of the eight always has the same bytes and shift."""
    rows = -(-len(values) // 8)
    eights = np.zeros((rows, 8), np.uint64)
    eights.reshape(-1)[: len(values)] = values
    out = np.zeros((rows, width), np.uint8)
    for r in range(8):
        byte, shift = divmod(r * width, 8)
        bits = eights[:, r] << np.uint64(shift)
        for j in range(-(-(shift + width) // 8)):
            out[:, byte + j] |= (bits >> np.uint64(8 * j)).astype(np.uint8)
    return out.tobytes()[: -(-len(values) * width // 8)] + bytes(8)


def encoded(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as directly addressable codes."""
    widths, rest = fitted_widths(values), values.astype(np.uint32)
    out = [MAGIC, struct.pack("<B", len(widths)), bytes(widths)]
    for k, width in enumerate(widths):
        out += [struct.pack("<Q", len(rest)), _packed(rest & np.uint32((1 << width) - 1), width)]
        if k == len(widths) - 1:
            break
        rest = rest >> np.uint32(width)
        more = rest > 0
        # One bit beyond the last is read as well, so there is always a block behind it.
        blocks = len(more) // RANK_BITS + 1
        bitmap = np.zeros(blocks * RANK_BITS, bool)
        bitmap[: len(more)] = more
        ranks = np.r_[0, np.cumsum(bitmap.reshape(blocks, RANK_BITS).sum(axis=1))[:-1]]
        out += [np.packbits(bitmap, bitorder="little").tobytes(), ranks.astype("<u4").tobytes()]
        rest = rest[more]
    return b"".join(out)


class Codes:
    """Random access to numbers that encoded() wrote, from the bytes as they are."""

    def __init__(self, data: bytes | memoryview) -> None:
        view = memoryview(data)
        if bytes(view[:4]) != MAGIC:
            raise ValueError("not a sequence of directly addressable codes")
        self.widths = list(view[5 : 5 + view[4]])
        self.windows, self.words, self.ranks = [], [], []
        at = 5 + len(self.widths)
        for k, width in enumerate(self.widths):
            n = struct.unpack_from("<Q", view, at)[0]
            size = -(-n * width // 8) + 8
            # Overlapping 64-bit windows, one for each byte.
            self.windows.append(np.ndarray((size - 7,), "<u8", view, at + 8, (1,)))
            self.n = n if k == 0 else self.n
            at += 8 + size
            if k < len(self.widths) - 1:
                blocks = n // RANK_BITS + 1
                self.words.append(np.ndarray((blocks * RANK_BITS // 64,), "<u8", view, at))
                at += blocks * RANK_BITS // 8
                self.ranks.append(np.ndarray((blocks,), "<u4", view, at))
                at += 4 * blocks
        self.size = at

    def __len__(self) -> int:
        return self.n

    def _chunks(self, level: int, places: np.ndarray) -> np.ndarray:
        bit, width = places * self.widths[level], self.widths[level]
        return (self.windows[level][bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)

    def _goes_on(self, level: int, places: np.ndarray) -> np.ndarray:
        return (self.words[level][places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1) == 1

    def _rank(self, level: int, places: np.ndarray) -> np.ndarray:
        """The number of ones before each place: the directory's entry, whole words behind it, the bits of the last word."""
        words, block = self.words[level], places // RANK_BITS
        out, last = self.ranks[level][block].astype(np.int64), places >> 6
        for word in range(RANK_BITS // 64 - 1):
            at = block * (RANK_BITS // 64) + word
            out += np.where(at < last, np.bitwise_count(words[at]), 0)
        below = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
        return out + np.bitwise_count(words[last] & below)

    def at(self, places: np.ndarray) -> np.ndarray:
        """The numbers at any places, in the order asked for."""
        places = np.asarray(places, np.int64)
        if len(places) and not (0 <= places.min() and places.max() < self.n):
            raise IndexError("a place is outside the sequence")
        out = np.zeros(len(places), np.uint64)
        asked, shift = np.arange(len(places)), 0
        for level, width in enumerate(self.widths):
            out[asked] |= self._chunks(level, places) << np.uint64(shift)
            if level == len(self.widths) - 1 or not len(places):
                break
            on = self._goes_on(level, places)
            asked, places, shift = asked[on], self._rank(level, places[on]), shift + width
        return out.astype(np.uint32)

    def _chunk_run(self, level: int, start: int, end: int) -> np.ndarray:
        """The chunks of neighbours: every eighth has the same shift, at bytes that lie the level's width apart."""
        width, windows = self.widths[level], self.windows[level]
        out = np.empty(end - start, np.uint32)
        for r in range(min(8, end - start)):
            byte, shift = divmod((start + r) * width, 8)
            part = windows[byte::width][: -(-(end - start - r) // 8)]
            out[r::8] = (part >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        return out

    def run(self, start: int, end: int) -> np.ndarray:
        """The numbers from start to before end. What goes on lies in one piece in each level, between two ranks."""
        out = asked = None
        shift = 0
        for level, width in enumerate(self.widths):
            chunks = self._chunk_run(level, start, end)
            if level == 0:
                out = chunks
            else:
                out[asked] |= chunks << np.uint32(shift)
            if level == len(self.widths) - 1 or start == end:
                break
            bits = np.unpackbits(self.words[level].view(np.uint8)[start >> 3 : (end + 7) >> 3], bitorder="little")
            on = np.flatnonzero(bits[start & 7 : (start & 7) + end - start])
            asked = on if level == 0 else asked[on]
            start, end = self._rank(level, np.array([start, end])).tolist()
            shift += width
        return out


def segment_bytes(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """A segment: number of documents, their ids (0 for null) and marks of nulls, numbers of token ids, and the token ids."""
    null = np.array([d is None for d in doc_ids], bool)
    names = np.array([d or 0 for d in doc_ids], "<i8")
    lengths = np.array([len(x) // 4 for x in ids], np.uint32)
    head = struct.pack("<Q", len(doc_ids)) + names.tobytes() + np.packbits(null, bitorder="little").tobytes()
    return head + encoded(lengths) + encoded(np.frombuffer(b"".join(ids), "<u4"))


class Segment:
    """A segment's documents and token ids."""

    def __init__(self, data: bytes) -> None:
        n = struct.unpack_from("<Q", data)[0]
        null = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), 8 + 8 * n), count=n, bitorder="little").astype(bool)
        self.doc_ids = [None if z else d for d, z in zip(np.frombuffer(data, "<i8", n, 8).tolist(), null.tolist())]
        rest = memoryview(data)[8 + 8 * n + -(-n // 8) :]
        lengths = Codes(rest)
        self.ends = np.cumsum(lengths.run(0, n).astype(np.int64))
        self.ids = Codes(rest[lengths.size :])

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Each document's id, the number of token ids before it in the segment, and its token ids."""
        start = first = 0
        ends = self.ends.tolist()
        run = self.ids.run(0, 0)
        for doc_id, end in zip(self.doc_ids, ends):
            if end > first + len(run):
                to = int(np.searchsorted(self.ends, start + RUN))
                first, run = start, self.ids.run(start, max(end, ends[min(to, len(ends) - 1)]))
            yield doc_id, start, run[start - first : end - first]
            start = end


@lru_cache(maxsize=1)
def _encoder(vocabulary: str) -> Callable[[str | None], bytes]:
    """The encoder of a Python worker, with the pieces that its earlier tasks have met."""
    return Ids(vocabulary).of


def _writer(encode: Callable[[], Callable[[str | None], bytes]], end: bytes, segment_tokens: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, context = encode(), TaskContext.get()
        file, segment, first, held = context.partitionId() if context else 0, 0, 0, 0
        names: list[int | None] = []
        ids: list[bytes] = []

        def closed() -> pa.RecordBatch:
            row = (file, segment, first, held, len(names), segment_bytes(names, ids))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, SEGMENTS.types)], schema=SEGMENTS)

        for part in parts:
            for doc_id, text in zip(column_of(part, "id"), column_of(part, "text")):
                names.append(doc_id)
                ids.append(ids_of(text) + end)
                held += len(ids[-1]) // 4
                if held >= segment_tokens:
                    yield closed()
                    segment, first, held, names, ids = segment + 1, first + held, 0, [], []
        if names:
            yield closed()

    return run


def write_ids(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, segment_tokens: int = SEGMENT, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the token ids of all documents, each followed by end_id, to a new folder in ascending order of documents.

    vocabulary: the path of a tokenizer file that every executor can read.
    """
    end = np.array([end_id], "<u4").tobytes()
    # Rows of one id (a hot one too) are told apart by their text, repeated rows by their place in the input.
    picked = docs.select(named(id_col).cast("long").alias("id"), named(text_col).alias("text"))
    picked = picked.select("*", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("k"))
    dealt = picked.repartitionByRange("id", "h", "k").sortWithinPartitions("id", "h", "k").select("id", "text")
    segments = dealt.mapInArrow(_writer(lambda: _encoder(vocabulary), end, segment_tokens), SEGMENTS_DDL)
    segments.write.option("compression", "none").parquet(f"{folder}/segments")
    # A row a file: as many as the tasks that wrote.
    files = read_segments(docs.sparkSession, folder).groupBy("file").agg(F.sum("n_tokens").alias("n_tokens"))
    before = F.sum("n_tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    files.select("file", F.coalesce(before, F.lit(0)).alias("first"), "n_tokens").write.parquet(f"{folder}/index")


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SEGMENTS_DDL).parquet(f"{folder}/segments")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("file int, first long, n_tokens long").parquet(f"{folder}/index")


def _documents(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for part in parts:
            for file, first, data in zip(*(column_of(part, c) for c in ("file", "first", "data"))):
                for doc_id, start, ids in Segment(data).documents():
                    yield doc_id, file, first + start, len(ids), zlib.crc32(ids.astype("<u4", copy=False))

    yield from batches(rows(), DOCUMENTS, 8000)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """From the files: each document's id, the number of ids before it in all files, its number of ids, and their crc32."""
    found = read_segments(spark, folder).select("file", "first", "data").mapInArrow(_documents, DOCUMENTS_DDL)
    index = read_index(spark, folder).select("file", F.col("first").alias("before"))
    return found.join(index, "file").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def _tokens(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("position", pa.int64()), ("token", pa.int64())])
    for part in parts:
        for begin, data, positions in zip(*(column_of(part, c) for c in ("begin", "data", "positions"))):
            positions = np.array(positions, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(positions), pa.array(Segment(data).ids.at(positions - begin).astype(np.int64))], schema=schema)


def tokens_at(spark: SparkSession, folder: str, positions: DataFrame) -> DataFrame:
    """position, token for the distinct positions (a long column of that name) that the corpus has. Only segments that a
    position falls into are opened; a segment has at most as many different positions as ids."""
    index = read_index(spark, folder).select("file", F.col("first").alias("before"))
    segments = read_segments(spark, folder).join(index, "file")
    begin = F.col("before") + F.col("first")
    spans = segments.select("file", "segment", begin.alias("begin"), (begin + F.col("n_tokens")).alias("end"))
    stretches = F.sequence(F.shiftright("begin", STRETCH_BITS), F.shiftright(F.col("end") - 1, STRETCH_BITS))
    asked = positions.select(F.col("position").cast("long").alias("position")).where("position >= 0").distinct()
    met = spans.select("*", F.explode(stretches).alias("stretch")).join(asked.withColumn("stretch", F.shiftright("position", STRETCH_BITS)), "stretch")
    wanted = met.where("position >= begin and position < end").groupBy("file", "segment", "begin").agg(F.collect_list("position").alias("positions"))
    opened = wanted.join(read_segments(spark, folder).select("file", "segment", "data"), ["file", "segment"])
    return opened.select("begin", "data", "positions").mapInArrow(_tokens, "position long, token long")
