"""Removal of repeated passages with compressed FM-indexes.

A window is `WINDOW` consecutive words of a document. Equal windows hold equal minimizers (the least hash of their runs
of `GRAM` words), so the documents are cut into segments, maximal runs of windows with one minimizer, and segments are
dealt to shards by it: all occurrences of a window meet in one shard, and no shard has to see the whole corpus. Equal
segments are merged before that (the smallest doc_id stays), segments whose minimizer no other document holds are
settled, and only the representatives of the rest carry text.

A shard's representatives are indexed by a compressed FM-index: the words before the suffixes (the transform) lie in a
wavelet tree of packed bit planes, whose ranks are sampled once for each 64 bits and counted from there. All segments of
the shard are then streamed through it by backward search in step: from the suffix range of the window one word to the
right, the range of its first WINDOW - 1 words (parent range, by ranks and selects on marks of where neighbours differ
within that many words) is extended by the word on the left through the wavelet tree. Its matching statistic, cut off at
WINDOW, is thus known at every place; each window's range gives the smallest document that holds it. Shards are worked in
pieces of `SHARD_WORDS` words that never split a minimizer.

A minimizer with more than `MOST_SEGMENTS` different segments (the edges of a passage that very many documents share)
would make one shard large. Its segments are cut again, into runs of windows with one core: the words around the
minimizer that all of them hold, in steps of 8 words. Equal windows have equal cores, so they meet again, in a shard of
that core; a core that is still too common is widened, in steps of 4, of 2, and at last to the whole window, of which
there is one. So every window goes through an FM-index or is the only one of its kind, and no shard grows with a passage.

Defined results: null text has no words; a document of fewer than WINDOW words loses nothing; only windows of other
documents (smaller doc_id) count, so repeats inside a document stay; rows that repeat a doc_id are cut each for itself and never against
each other; a null doc_id takes no part and loses nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagewright.llm.common import WordHashes, batches, boxed, checkpointed, column_of, mixed, named, words_of

WINDOW = 50
GRAM = 8
SHARD_WORDS = 400_000
MOST_SEGMENTS = 1500

_DRAW = np.random.default_rng(20240202)
_GRAM_PLACE = _DRAW.integers(0, 2**63, size=GRAM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEGMENT_PLACE = _DRAW.integers(0, 2**63, size=2 * WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse of 64 bits
_POWERS, _INVERSES = (np.array([pow(b, k, 2**64) for k in range(2 * WINDOW)], np.uint64) for b in (_BASE, pow(_BASE, -1, 2**64)))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values, by doubling."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def gram_hashes(h: np.ndarray) -> np.ndarray:
    """Hashes of the runs of GRAM words of a text with word hashes h."""
    n = len(h) - GRAM + 1
    g = np.zeros(n, np.uint64)
    for k in range(GRAM):
        g += h[k : n + k] * _GRAM_PLACE[k]
    return mixed(g)


def segments(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimizer of each segment of a document with word hashes h."""
    if len(h) < WINDOW:
        return (np.zeros(0, np.int64),) * 3
    least = sliding_min(gram_hashes(h), WINDOW - GRAM + 1)
    # A run stops after WINDOW windows at the latest, counted from its start, so that segments stay short in texts that
    # repeat themselves; equal windows still hold equal minimizers.
    change = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    size = np.diff(np.r_[change, len(least)])
    if size.max() > WINDOW:
        change = np.concatenate([np.arange(a, a + s, WINDOW) for a, s in zip(change, size)])
        size = np.diff(np.r_[change, len(least)])
    return change, size, least[change].view(np.int64)


_POSITIONS_DDL = "id long, row long, start int, windows int, key long, seg long"
_POSITIONS = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("key", pa.int64()), ("seg", pa.int64())])


def _positions(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for part in parts:
        out = []
        for i, row, text in zip(*(c.to_pylist() for c in part.columns)):
            h = hashes.of(words_of(text))
            start, size, key = segments(h)
            if not len(start):
                continue
            # A segment's own hash: of all its words, by place.
            length = size + WINDOW - 1
            within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            terms = h[np.repeat(start, length) + within] * _SEGMENT_PLACE[within]
            seg = mixed(np.add.reduceat(terms, np.cumsum(length) - length) + length.astype(np.uint64))
            out.append((np.full(len(start), i), np.full(len(start), row), start.astype(np.int32), size.astype(np.int32), key, seg.view(np.int64)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out), _POSITIONS.types)], schema=_POSITIONS)


class Bits:
    """A bit vector with ranks: words of 64 bits, and the number of ones before each word."""

    def __init__(self, bit: np.ndarray) -> None:
        packed = np.packbits(bit, bitorder="little")
        self.words = np.pad(packed, (0, -len(packed) % 8 + 8)).view(np.uint64)
        self.before = np.cumsum(np.r_[0, np.bitwise_count(self.words[:-1])], dtype=np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The number of ones before each place."""
        word = at >> 6
        inside = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(inside)


class FMIndex:
    """Words of concatenated segments, suffixes sorted by their first WINDOW words, and a wavelet tree over the
    transform. Each segment ends in a mark of its own value 0, which no search enters."""

    def __init__(self, ids: np.ndarray, n_words: int, owner: np.ndarray) -> None:
        n = self.n = len(ids)
        # Ranks by the first 1, 2, 4, ... words; a suffix that runs out is smaller.
        rank = ids.astype(np.int64)
        k = 1
        while 2 * k <= WINDOW:
            rank, _ = self._ranks(rank, rank, k)
            k *= 2
        near = self._ranks(rank, rank, WINDOW - 1 - k)[0] if k < WINDOW - 1 else rank
        full, order = self._ranks(rank, rank, WINDOW - k)
        # Marks of the first suffix of each run with equal first WINDOW and WINDOW - 1 words.
        at = full[order]
        start = np.r_[True, at[1:] != at[:-1]]
        self.groups = Bits(start)
        self.smallest = np.minimum.reduceat(owner[order], np.flatnonzero(start))
        at = near[order]
        start = np.r_[True, at[1:] != at[:-1]]
        self.parents = Bits(start)
        self.edges = np.r_[np.flatnonzero(start), n].astype(np.int32)
        self.before = np.r_[0, np.cumsum(np.bincount(ids, minlength=n_words + 1))].astype(np.int32)
        # Wavelet tree as bit planes from the highest bit (each plane stably sorted by the bits above).
        self.planes: list[tuple[Bits, int]] = []
        self.bits = max(1, int(n_words).bit_length())
        now = ids[order - 1].astype(np.int32)  # the transform; order 0 wraps to the last mark
        for b in range(self.bits - 1, -1, -1):
            bit = ((now >> b) & 1).astype(bool)
            self.planes.append((Bits(bit), n - int(bit.sum())))
            now = np.concatenate([now[~bit], now[bit]])
        # Where each word's run begins once all planes have sorted them.
        every = np.arange(n_words + 1)
        self.starts = self._down(every, np.zeros(n_words + 1, np.int64))

    @staticmethod
    def _ranks(a: np.ndarray, b: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
        second = np.zeros(len(a), np.int64)
        second[: len(b) - shift] = b[shift:] + 1
        both = a * np.int64(len(a) + 2) + second
        order = np.argsort(both, kind="stable")
        sorted_ = both[order]
        new = np.cumsum(np.r_[False, sorted_[1:] != sorted_[:-1]])
        rank = np.empty(len(a), np.int64)
        rank[order] = new
        return rank, order

    def _down(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        for j, (bits, zeros) in enumerate(self.planes):
            ones = bits.rank(at)
            at = np.where((word >> (self.bits - 1 - j)) & 1, zeros + ones, at - ones)
        return at

    def extend(self, word: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: the suffix ranges of each word followed by what the ranges hold."""
        both = self._down(np.concatenate([word, word]), np.concatenate([lo, hi]))
        # After all planes the words stand sorted; occurrences before the range are counted from the word's own start.
        base = self.before[word] - self.starts[word]
        return base + both[: len(word)], base + both[len(word) :]

    def parent(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of the first WINDOW - 1 words of the suffixes at lo."""
        k = self.parents.rank(lo + 1)
        return self.edges[k - 1], self.edges[k]

    def holder(self, lo: np.ndarray) -> np.ndarray:
        """The smallest owner of the windows whose ranges begin at lo."""
        return self.smallest[self.groups.rank(lo + 1) - 1]


def first_holders(texts: list[list[bytes]], docs: np.ndarray) -> list[np.ndarray]:
    """For each segment (its words), the smallest of docs that holds each of its windows, within these segments."""
    ids_of: dict[bytes, int] = {}
    flat = [ids_of.setdefault(w, len(ids_of) + 1) for words in texts for w in (*words, None) if w is not None]
    length = np.array([len(w) for w in texts], np.int64)
    ends = np.cumsum(length + 1) - 1  # where the marks stand
    ids = np.zeros(int(ends[-1]) + 1, np.int64)
    real = np.ones(len(ids), bool)
    real[ends] = False
    ids[real] = flat
    index = FMIndex(ids, len(ids_of), np.repeat(docs, length + 1))
    windows = length - WINDOW + 1
    out = np.empty(int(windows.sum()), np.int64)
    out_end = np.cumsum(windows)
    # The last window of each segment is found by WINDOW steps from the empty word; the others by one step each.
    by_size = np.argsort(-windows, kind="stable")
    lo, hi = np.zeros(len(texts), np.int64), np.full(len(texts), index.n, np.int64)
    for back in range(1, WINDOW + 1):
        lo, hi = index.extend(ids[ends - back], lo, hi)
    out[out_end - 1] = index.holder(lo)
    sizes = -windows[by_size]
    for step in range(1, int(windows.max())):
        live = by_size[: np.searchsorted(sizes, -step)]  # segments with more than step windows
        a, z = index.extend(ids[ends[live] - WINDOW - step], *index.parent(lo[live]))
        lo[live], hi[live] = a, z
        out[out_end[live] - 1 - step] = index.holder(a)
    return np.split(out, out_end[:-1])


_RUNS_DDL = "key long, seg long, windows int, off int, len int, first long"
_RUNS = pa.schema([("key", pa.int64()), ("seg", pa.int64()), ("windows", pa.int32()), ("off", pa.int32()), ("len", pa.int32()), ("first", pa.int64())])


def _runs(first: np.ndarray) -> Iterator[tuple[int, int, int]]:
    edges = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
    for a, s in zip(edges, np.diff(np.r_[edges, len(first)])):
        yield int(a), int(s), int(first[a])


def _shards(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; pieces of whole keys are indexed and searched."""
    held: list[tuple] = []

    def worked() -> Iterator[tuple]:
        found = first_holders([w for *_, w in held], np.array([d for _, _, _, d, _ in held], np.int64))
        for (key, seg, windows, _, _), first in zip(held, found):
            for off, size, doc in _runs(first):
                yield key, seg, windows, off, size, doc

    def rows() -> Iterator[tuple]:
        nonlocal held
        last, n = None, 0
        for part in parts:
            for key, seg, windows, doc, text in zip(*(column_of(part, c) for c in ("key", "seg", "windows", "doc", "text"))):
                if key != last and n >= SHARD_WORDS:
                    yield from worked()
                    held, n = [], 0
                words = text.encode("utf-8", "surrogatepass").split()
                held.append((key, seg, windows, doc, words))
                last, n = key, n + len(words)
        if held:
            yield from worked()

    yield from batches(rows(), _RUNS, 20_000)


_REPS_DDL = "key long, seg long, windows int, doc long, hot boolean, text string"
_REPS = pa.schema([("key", pa.int64()), ("seg", pa.int64()), ("windows", pa.int32()), ("doc", pa.int64()), ("hot", pa.bool_()), ("text", pa.string())])


def _cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each wanted segment of a document."""

    def rows() -> Iterator[tuple]:
        for part in parts:
            for doc, text, wanted in zip(*(column_of(part, c) for c in ("id", "text", "wanted"))):
                words = words_of(text)
                for w in wanted:
                    piece = b" ".join(words[w["start"] : w["start"] + w["windows"] + WINDOW - 1])
                    yield w["key"], w["seg"], w["windows"], doc, w["hot"], piece.decode("utf-8", "surrogatepass")

    yield from batches(rows(), _REPS, 4000)


_ORIGIN = ["o_key", "o_seg", "o_windows", "o_off"]
_CORES_DDL = "o_key long, o_seg long, o_windows int, o_off int, key long, seg long, windows int, doc long, text string"
_CORES = pa.schema([("o_key", pa.int64()), ("o_seg", pa.int64()), ("o_windows", pa.int32()), ("o_off", pa.int32()), *((n, _REPS.field(n).type) for n in ("key", "seg", "windows", "doc", "text"))])


def _cores(step: int):
    """Segments of a minimizer (o_key) cut into runs of windows with one core, which becomes their key."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()

        def rows() -> Iterator[tuple]:
            for part in parts:
                for o_key, o_seg, o_windows, o_off, windows, doc, text in zip(*(column_of(part, c) for c in (*_ORIGIN, "windows", "doc", "text"))):
                    words = words_of(text)
                    h = hashes.of(words)
                    at = np.flatnonzero(gram_hashes(h).view(np.int64) == o_key)
                    first = np.arange(windows)
                    at = at[np.searchsorted(at, first)]  # where the minimizer first stands in each window
                    left, right = (at - first) // step * step, (WINDOW - GRAM - at + first) // step * step
                    lo, hi = at - left, at + GRAM + right
                    sums = np.r_[np.uint64(0), np.cumsum(h * _POWERS[: len(h)])]
                    core = (sums[hi] - sums[lo]) * _INVERSES[lo]
                    key = mixed(core + mixed(((step * WINDOW + left) * WINDOW + right).astype(np.uint64)) + np.int64(o_key).view(np.uint64)).view(np.int64)
                    # Of windows that are their own core, each is a run by itself.
                    edges = first if step == 1 else np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                    for a, n in zip(edges.tolist(), np.diff(np.r_[edges, windows]).tolist()):
                        own = h[a : a + n + WINDOW - 1]
                        seg = mixed((own * _SEGMENT_PLACE[: len(own)]).sum(keepdims=True) + np.uint64(len(own))).view(np.int64)
                        yield o_key, o_seg, o_windows, o_off + a, int(key[a]), int(seg[0]), n, doc, b" ".join(words[a : a + n + WINDOW - 1]).decode("utf-8", "surrogatepass")

        yield from batches(rows(), _CORES, 4000)

    return run


def _split(hot: DataFrame, most_segments: int) -> Iterator[DataFrame]:
    """Runs (as of _shards) of segments (key, seg, windows, doc, text) of too common minimizers, by ever wider cores."""
    now = hot.select(F.col("key").alias("o_key"), F.col("seg").alias("o_seg"), F.col("windows").alias("o_windows"), F.lit(0).alias("o_off"), "windows", "doc", "text")
    for step in (8, 4, 2, 1):
        if now.isEmpty():
            return
        cut = checkpointed(now.mapInArrow(_cores(step), _CORES_DDL))
        same = cut.groupBy("key", "seg", "windows").agg(F.min("doc").alias("doc"), F.any_value("text").alias("text"))
        sizes = cut.select("key", "seg", "windows").distinct().groupBy("key").agg(F.count("*").alias("n"))
        same = checkpointed(same.join(sizes, "key"))
        alone = same.where("n = 1").select("key", "seg", "windows", F.lit(0).alias("off"), F.col("windows").alias("len"), F.col("doc").alias("first"))
        cold = same.where((F.col("n") > 1) & (F.col("n") <= most_segments)).drop("n").repartition("key").sortWithinPartitions("key")
        runs = alone.unionByName(cold.mapInArrow(_shards, _RUNS_DDL))
        met = cut.select(*_ORIGIN, "key", "seg", "windows").join(runs, ["key", "seg", "windows"])
        yield met.select(F.col("o_key").alias("key"), F.col("o_seg").alias("seg"), F.col("o_windows").alias("windows"), (F.col("o_off") + F.col("off")).alias("off"), "len", "first")
        now = cut.join(sizes.where(F.col("n") > most_segments), "key", "left_semi")


def repeats(rows: DataFrame, most_segments: int = MOST_SEGMENTS) -> tuple[DataFrame, DataFrame]:
    """id, row, spans of every row of rows (id, row, text) that loses words: [start, end) in words, as array of structs.
    row tells the rows of one id apart.

    The second frame is rows as dealt by id and row, for a join that needs no further shuffle of the texts.
    """
    positions = checkpointed(rows.where("id is not null").select("id", "row", "text").mapInArrow(_positions, _POSITIONS_DDL))
    same = positions.groupBy("key", "seg", "windows").agg(F.min("id").alias("doc"), F.max("id").alias("max_doc"))
    same = checkpointed(same)
    by_key = same.groupBy("key").agg(F.count("*").alias("n"), F.min("doc").alias("lo"), F.max("max_doc").alias("hi"))
    shared = checkpointed(same.join(by_key.where("lo < hi").select("key", "n"), "key").select("key", "seg", "windows", "doc", (F.col("n") > most_segments).alias("hot")))
    # One occurrence of each segment in its smallest document carries the text.
    found = positions.join(shared, ["key", "seg", "windows"]).where("id = doc")
    one = found.groupBy("key", "seg", "windows", "hot", "id").agg(F.min(F.struct("row", "start")).alias("at"))
    wanted = one.groupBy("id", F.col("at.row").alias("row")).agg(F.collect_list(F.struct("key", "seg", "windows", "hot", F.col("at.start").alias("start"))).alias("wanted"))
    dealt = rows.repartition("id", "row")
    cut = dealt.join(wanted, ["id", "row"]).select("id", "text", "wanted").mapInArrow(_cut, _REPS_DDL)
    cut = checkpointed(cut)
    cold = cut.where("not hot").drop("hot").repartition("key").sortWithinPartitions("key")
    runs = cold.mapInArrow(_shards, _RUNS_DDL)
    for more in _split(cut.where("hot").drop("hot"), most_segments):
        runs = runs.unionByName(more)
    runs = checkpointed(runs)
    hit = positions.join(runs, ["key", "seg", "windows"]).where("first < id")
    spans = hit.select("id", "row", (F.col("start") + F.col("off")).alias("a"), (F.col("start") + F.col("off") + F.col("len") + WINDOW - 1).alias("z"))
    return spans.groupBy("id", "row").agg(F.collect_list(F.struct("a", "z")).alias("spans")), dealt


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, z in sorted((s["a"], s["z"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def _finish(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        n_words, n_removed, kept = [], [], []
        for text, spans in zip(column_of(part, "text"), column_of(part, "spans")):
            words = words_of(text)
            at, stay = 0, []
            for a, z in _merged(spans):
                stay += words[at:a]
                at = z
            stay += words[at:]
            n_words.append(len(words))
            n_removed.append(len(words) - len(stay))
            kept.append(b" ".join(stay).decode("utf-8", "surrogatepass"))
        sha = [hashlib.sha256(k.encode("utf-8", "surrogatepass")).hexdigest() for k in kept]
        yield pa.RecordBatch.from_arrays(
            [part.column(part.schema.get_field_index("row")), pa.array(n_words), pa.array(n_removed), pa.array(sha), pa.array([k if r else None for k, r in zip(kept, n_removed)], pa.string())],
            names=["row", "n_words", "n_removed", "kept_sha256", "kept"],
        )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, row, n_words, n_removed, kept_sha256, kept of every row; kept is the text that is left (words joined by one
    space), null where nothing was removed.

    row tells rows of one id apart; it is a hash of the text, so rows repeated exactly have one row value.
    """
    rows = docs.select(named(id_col).cast("long").alias("id"), named(text_col).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("text"))
    spans, dealt = repeats(rows)
    done = dealt.join(spans, ["id", "row"], "left").select("id", "row", "text", "spans")
    return done.mapInArrow(_finish_with_id, "id long, row long, n_words long, n_removed long, kept_sha256 string, kept string")


def _finish_with_id(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        (done,) = _finish(iter([part]))
        yield pa.RecordBatch.from_arrays([part.column(0), *done.columns], names=["id", *done.schema.names])


def _cleaner(columns: list[str], text_at: int, chars_at: int | None):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            box = part.column(0)
            out = box.flatten()
            texts, chars = out[text_at].to_pylist(), None if chars_at is None else out[chars_at].to_pylist()
            for i, spans in enumerate(part.column(1).to_pylist()):
                if spans:
                    words = words_of(texts[i])
                    stay, at = [], 0
                    for a, z in _merged(spans):
                        stay += words[at:a]
                        at = z
                    texts[i] = b" ".join(stay + words[at:]).decode("utf-8", "surrogatepass")
                    if chars is not None:
                        chars[i] = len(texts[i])
            out[text_at] = pa.array(texts, out[text_at].type)
            if chars is not None:
                out[chars_at] = pa.array(chars, out[chars_at].type)
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(out, fields=list(box.type))], names=["box"])

    return run


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs without their repeated passages. A text that loses words is its kept words joined by one space, and its
    number of characters (where docs has that column) is counted again; other texts and columns stay as they are."""
    keyed = boxed(docs, id=named(id_col).cast("long"), row=F.xxhash64(named(text_col)))
    text = F.col("box").getField(text_col)
    spans, _ = repeats(keyed.select("id", "row", text.alias("text")))
    both = keyed.join(spans, ["id", "row"], "left").select("box", "spans")
    chars_at = docs.columns.index(chars_col) if chars_col in docs.columns else None
    return both.mapInArrow(_cleaner(docs.columns, docs.columns.index(text_col), chars_at), StructType([both.schema["box"]])).select("box.*")
