"""Packing of documents into windows of equal length by the online sum-of-squares rule.

A document's token ids are cut into full windows and a rest. Rests arrive one by one. Windows are told apart by their
level, the number of steps of `STEP` tokens that they still have room for; N(r) is the number of open windows of level
r, kept in the level array. A rest of u steps goes to the level whose change of the sum of N(r)^2 is least:

    new window of R steps: 2 N(R-u) + 1;   level r >= u: (1 - 2 N(r)) + (2 N(r-u) + 1, or 0 if r = u fills the window).

The rule keeps no level crowded, so that fitting partners stay at hand. A rest that fills its window closes it: what is
over (less than a step) is cut off and placed again, what is missing (less than a step) is the start of the next
document. So nearly all tokens lie where the rule puts them, and about one hundredth in such cuts.

Each task packs the documents of its partition in their order and holds at most `most_open` open windows: beyond that a
rest that asks for a new one fills up the fullest first. At its end, the windows still open are poured together, fullest
first, by cutting; the last, partly filled one is cut at powers of two, whose lengths need no padding.

Defined results: null text is the empty text and has its end id only; repeated rows are packed as often as they stand;
ties of the rule go to the fullest level; an empty table gives no pieces. Windows never mix partitions, so no id passes
between tasks and a lost task repeats with the same pieces. Columns of docs other than its id and text are not read. A
text's ids are those of tokenizers' encode(); a special token's marker in a text gets that token's id, as there.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from pagewright.llm.common import batches, column_of, named

WINDOW = 2048
STEP = 64
MOST_OPEN = 4096

PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)
PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Letters of the texts that are split here; all regex engines agree on their class and on that of the other characters.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
PLAIN = rf"[\t\n\r\x20-\x7e¡-©«¬®-±´¶-¸»¿×÷{LETTERS}]*"
#: The byte-level pre-tokeniser's pattern over those characters (fixed value of the vocabulary file's format).
PIECE_PATTERN = rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+"


def byte_characters() -> dict[int, str]:
    """The byte-level format's character for each byte: printable bytes stand for themselves, others follow from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


class Ids:
    """Token ids of texts as little-endian unsigned 32-bit bytes, with remembered pieces for plain texts."""

    def __init__(self, vocabulary: str, most: int = 700_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.markers = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = re.compile(PIECE_PATTERN).findall
        self.plain = re.compile(PLAIN).fullmatch
        tokenize, characters = self.tokenizer.model.tokenize, byte_characters()

        class Known(dict):
            def __missing__(self, piece: str) -> bytes:
                if len(self) >= most:
                    self.clear()
                tokens = tokenize(piece.encode().decode("latin-1").translate(characters))
                ids = self[piece] = array("I", [t.id for t in tokens]).tobytes()
                return ids

        self.known = Known()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, text: str | None) -> bytes:
        if not text:
            return b""
        # The markers of added tokens go to the tokenizer, as do characters of any rarer kind.
        if any(m in text for m in self.markers) or not self.plain(text):
            return self.whole(text)
        return b"".join(map(self.known.__getitem__, self.pieces(text)))


class SumOfSquares:
    """Online packer of one task. give() takes a document's ids; closed windows come back as lists of pieces."""

    def __init__(self, window: int = WINDOW, step: int = STEP, most_open: int = MOST_OPEN) -> None:
        self.window, self.step, self.most_open = window, step, most_open
        self.levels = -(-window // step)
        self.count = np.zeros(self.levels + 1, np.int64)  # the level array; level 0, the closed windows, stays at 0
        self.open: list[list[tuple[int, list]]] = [[] for _ in range(self.levels + 1)]  # (room, pieces)
        self.held = 0
        self.nearly: tuple[int, list] | None = None  # a window that lacks less than a step
        self.by_rule = self.by_cut = 0  # tokens in windows closed so far: where the rule put them, or cut to fit

    def level_for(self, s: int) -> int:
        """The level a rest of s tokens goes to; 0 is a new window."""
        n, u = self.count, -(-s // self.step)
        gain = 1 - 2 * n[u:]  # levels u .. levels
        gain[1:] += 2 * n[1 : self.levels + 1 - u] + 1
        gain[n[u:] == 0] = np.iinfo(np.int64).max
        best = int(np.argmin(gain))
        new = 2 * n[self.levels - u] + 1 if u < self.levels else 0
        return u + best if gain[best] <= new else 0

    def _chosen(self, s: int) -> tuple[int, list]:
        if self.nearly is not None:
            chosen, self.nearly = self.nearly, None
            return chosen
        level = self.level_for(s)
        if not level and self.held >= self.most_open:
            level = int(np.flatnonzero(self.count)[0])
        if not level:
            return self.window, []
        self.count[level] -= 1
        self.held -= 1
        return self.open[level].pop()

    def give(self, doc_id: int | None, ids: bytes) -> Iterator[list[tuple]]:
        total = len(ids) // 4
        start = total - total % self.window
        for a in range(0, start, self.window):
            yield [(doc_id, a, self.window, ids[4 * a : 4 * (a + self.window)], total)]
        while start < total:
            room, pieces = self._chosen(total - start)
            take = min(room, total - start)
            pieces.append((doc_id, start, take, ids[4 * start : 4 * (start + take)], total))
            start, room = start + take, room - take
            if not room:
                cut = sum(p[2] for p in pieces if p[2] < self.step)
                self.by_cut, self.by_rule = self.by_cut + cut, self.by_rule + self.window - cut
                yield pieces
            elif room < self.step:
                self.nearly = room, pieces
            else:
                level = -(-room // self.step)
                self.count[level] += 1
                self.open[level].append((room, pieces))
                self.held += 1

    def emptied(self) -> Iterator[list[tuple]]:
        """What is still open, fullest first, poured into full windows; the rest is cut at powers of two."""
        held = [self.nearly] if self.nearly else []
        pour = [p for _, pieces in held + [w for level in self.open for w in level] for p in pieces]
        left = sum(p[2] for p in pour)
        now: list[tuple] = []
        room = min(self.window, 1 << (left.bit_length() - 1)) if left else 0
        for doc_id, start, length, ids, total in pour:
            while length:
                take = min(room, length)
                now.append((doc_id, start, take, ids[: 4 * take], total))
                start, length, ids, room, left = start + take, length - take, ids[4 * take :], room - take, left - take
                if not room:
                    yield now
                    now, room = [], min(self.window, 1 << (left.bit_length() - 1)) if left else 0
        self.__init__(self.window, self.step, self.most_open)


def _packer(encode: Callable[[], Callable[[str | None], bytes]], end: bytes, window: int, step: int, most_open: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encode()
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 40

        def rows() -> Iterator[tuple]:
            packer = SumOfSquares(window, step, most_open)
            sequence = base

            def closed(windows: Iterator[list[tuple]]) -> Iterator[tuple]:
                nonlocal sequence
                for pieces in windows:
                    offset = 0
                    for doc_id, start, length, ids, total in pieces:
                        yield doc_id, start, length, zlib.crc32(ids), total, sequence, offset
                        offset += length
                    sequence += 1

            for part in parts:
                for doc_id, text in zip(column_of(part, "id"), column_of(part, "text")):
                    yield from closed(packer.give(doc_id, ids_of(text) + end))
            yield from closed(packer.emptied())

        yield from batches(rows(), PIECES, 8000)

    return run


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, window: int = WINDOW, step: int = STEP, most_open: int = MOST_OPEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents: which ids of a document (start, length) lie where (sequence_id, offset).

    vocabulary: the path of a tokenizer file that every executor can read. ids_crc32 checks a piece's ids. sequence_id
    numbers a task's windows from its partition number times 2^40.
    """
    end = np.array([end_id], "<u4").tobytes()
    picked = docs.select(named(id_col).cast("long").alias("id"), named(text_col).alias("text"))
    return picked.mapInArrow(_packer(lambda: Ids(vocabulary).of, end, window, step, most_open), PIECES_DDL)
