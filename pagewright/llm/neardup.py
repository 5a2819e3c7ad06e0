"""Near-duplicate documents by MinHash with tensored banding.

A document's set holds the hashes of its distinct five-word shingles (words of ASCII white space cuts, A-Z in lower
case; with fewer words, the whole sequence as one). Two small collections of minhashes are made, U of `PAIRS` cells of
two minhashes and V of `SINGLES` cells of one. A table key combines one cell of U with one of V, so that 10 x 6 tables
need 26 minhashes instead of 180. A pair of similarity s shares a key with probability
(1 - (1 - s^2)^10) (1 - (1 - s)^6): 0.9995 at s = 0.75.

Equal sets (by SHA-256 of the whole sorted set) are merged first. Then candidates are confirmed on full sets, without
forming all pairs of a bucket: first each member of a bucket with the bucket's first; then, where a bucket still holds
several components, each member outside its largest one with a member of that; and at last members of different
components that can reach each other. Those are found by their rare shingles: shingles are ordered by how many of the
documents concerned hold them, and of two documents of similarity t the first n - 2t/(1+t) n + 1 of the one with fewer
shingles and the first m - t m + 1 of the other one have one in common. Shingles that nobody else has come first, so
that near misses with words of their own meet nobody. A map of `CELLS` hashed cells for each document bounds what two of
them share (cells that both have, and the lesser number of shingles beyond one in a cell), before any pair is formed; the
pairs left are decided exactly on the shingles that each shares with anybody. So every pair in a bucket is either
connected, compared, or proven to be no link.

Defined results: null text and text without words have an empty set, link with nothing and are kept; rows that repeat a
doc_id are one document (linked if any of its texts is); a null id takes no part in links and has a null component;
an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import WordHashes, boxed, checkpointed, column_of, mixed, named
from pagewright.llm.components import components

SHINGLE = 5
PERCENT = 75
PAIRS, SINGLES = 10, 6
CELLS = 2048
_N = 2 * PAIRS + SINGLES
_DRAW = np.random.default_rng(20240101)
_XOR = _DRAW.integers(0, 2**63, size=(_N, 1), dtype=np.uint64)
_MUL = _DRAW.integers(0, 2**63, size=(_N, 1), dtype=np.uint64) | np.uint64(1)
_PLACE = (_DRAW.integers(0, 2**63, size=SHINGLE, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.of(words)
    if len(h) < SHINGLE:
        return mixed((h * _PLACE[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))
    s = np.zeros(len(h) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        s += h[k : len(h) - SHINGLE + 1 + k] * _PLACE[k]
    return np.unique(mixed(s))


def minhashes(s: np.ndarray) -> np.ndarray:
    least = np.full(_N, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), 1 << 15):
        least = np.minimum(least, ((s[None, a : a + (1 << 15)] ^ _XOR) * _MUL).min(axis=1))
    return least


def table_keys(m: np.ndarray) -> np.ndarray:
    """The keys of all tables: one for each pair of a U cell and a V cell."""
    u = mixed(m[0 : 2 * PAIRS : 2] + mixed(m[1 : 2 * PAIRS : 2]))
    v = m[2 * PAIRS :]
    tables = np.arange(PAIRS * SINGLES, dtype=np.uint64).reshape(PAIRS, SINGLES)
    return mixed(mixed(u[:, None] + v[None, :] * np.uint64(0x9E3779B97F4A7C15)) + tables).ravel().view(np.int64)


def alike(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or not len(a) or not len(b):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


_FEATURES = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64()))])
_FEATURES_DDL = "id long, row long, n long, digest binary, keys array<long>"


def _features(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for part in parts:
        n, digest, keys = [], [], []
        for text in part.column(2).to_pylist():
            s = shingles(text, hashes)
            n.append(len(s))
            digest.append(hashlib.sha256(s.tobytes()).digest() if len(s) else b"")
            keys.append(table_keys(minhashes(s)) if len(s) else [])
        yield pa.RecordBatch.from_arrays([*part.columns[:2], *(pa.array(c, t) for c, t in zip((n, digest, keys), _FEATURES.types[2:]))], schema=_FEATURES)


def _confirmed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, known = WordHashes(), {}

    def set_of(text: str) -> np.ndarray:
        s = known.get(text)
        if s is None:
            if len(known) >= 16:
                known.pop(next(iter(known)))
            s = known[text] = shingles(text, hashes)
        return s

    for part in parts:
        ta, tb = column_of(part, "ta"), column_of(part, "tb")
        ok = [alike(set_of(x), shingles(y, hashes)) for x, y in zip(ta, tb)]
        yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. texts: id, text. Both joins are by id, split where skewed."""
    tb = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    ta = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    both = pairs.join(tb, "b").join(ta, "a")
    return checkpointed(both.select("a", "b", "ta", "tb").mapInArrow(_confirmed, "a long, b long").distinct())


def _exploded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for part in parts:
        for a in range(0, part.num_rows, 64):
            piece = part.slice(a, 64)
            sets = [shingles(t, hashes) for t in column_of(piece, "text")]
            ids = np.repeat(np.array(column_of(piece, "id"), np.int64), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(sets).view(np.int64))], names=["id", "s"])


def _celled(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        cells = []
        for common in column_of(part, "common"):
            has = np.zeros(CELLS, bool)
            has[mixed(np.array(common, np.int64).view(np.uint64)) & np.uint64(CELLS - 1)] = True
            cells.append(np.packbits(has).view(np.int64))
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells, pa.list_(pa.int64()))], names=["id", "n", "common", "cells"])


def profiles(ids: DataFrame, texts: DataFrame, sizes: DataFrame) -> DataFrame:
    """What decides between the documents of ids (id), with sizes (id, n): id, n; common: those of its shingles that any
    other one has, rarest first; cells: a map of their hashes. Documents without common shingles are left out."""
    rows = checkpointed(texts.join(ids, "id", "left_semi").mapInArrow(_exploded, "id long, s long"))
    often = rows.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    common = rows.join(often, "s").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("c")).select("id", F.col("c.s").alias("common"))
    return common.join(sizes, "id").select("id", "n", "common").mapInArrow(_celled, "id long, n long, common array<long>, cells array<long>")


def prefix(share: Column) -> Column:
    """The common shingles among the first n - share + 1 of a document, its own ones standing before them."""
    alone = F.col("n") - F.size("common")
    return F.slice("common", F.lit(1), F.greatest(F.lit(0), F.col("n") - share + 1 - alone).cast("int"))


def bits(a: Column, b: Column) -> Column:
    """The number of bits that both arrays of longs have set."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x)


def enough(shared: Column) -> Column:
    """Whether so many shared shingles make documents of n and m shingles alike."""
    return (100 + PERCENT) * shared >= PERCENT * (F.col("n") + F.col("m"))


def reaching(open_: DataFrame, own: DataFrame) -> DataFrame:
    """a, b: documents of different labels (open_: id, label) that neither their rare shingles nor their cells rule out."""

    def share(of: int, parts: int) -> Column:  # of * n / parts, rounded up, in whole numbers
        return F.expr(f"({of} * n + {parts - 1}) div {parts}")

    excess = F.size("common") - bits(F.col("cells"), F.col("cells"))
    labelled = own.join(open_.select("id", "label").distinct(), "id").select("id", "n", "label", "cells", excess.alias("excess"), "common")
    long_ = labelled.select("id", "n", "label", "cells", "excess", F.explode(prefix(share(PERCENT, 100))).alias("s"))
    # Shingles of one label only join nothing; they are dropped before the join.
    several = checkpointed(long_.groupBy("s").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("s"))
    short = labelled.select("id", "n", "label", "cells", "excess", F.explode(prefix(share(2 * PERCENT, 100 + PERCENT))).alias("s")).join(several, "s", "left_semi")
    long_ = long_.join(several, "s", "left_semi").select("s", F.col("id").alias("id2"), F.col("n").alias("m"), F.col("label").alias("label2"), F.col("cells").alias("cells2"), F.col("excess").alias("excess2"))
    shorter = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("id") < F.col("id2")))
    able = (100 * F.col("n") >= PERCENT * F.col("m")) & enough(bits(F.col("cells"), F.col("cells2")) + F.least("excess", "excess2"))
    met = short.join(long_, (short.s == long_.s) & (F.col("label") != F.col("label2")) & shorter & able)
    return met.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def judged(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links, by the shingles that both have."""
    left = own.select(F.col("id").alias("a"), "n", "common")
    right = own.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("common").alias("common2"))
    met = pairs.join(left, "a").join(right, "b").where(enough(F.least(F.size("common"), F.size("common2"))))
    return checkpointed(met.where(enough(F.size(F.array_intersect("common", "common2")))).select("a", "b"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component of every row. Inside, the things that are linked are the different sets, by a number."""
    rows = docs.select(named(id_col).cast("long").alias("id"), F.xxhash64(named(text_col)).alias("row"), named(text_col).alias("text"))
    features = checkpointed(rows.mapInArrow(_features, _FEATURES_DDL))
    real = features.where("n > 0 and id is not null")
    merged = real.groupBy("digest", "n").agg(F.min(F.struct("id", "row")).alias("at"), F.any_value("keys").alias("keys"))
    merged = checkpointed(merged.select("digest", "n", "at.id", "at.row", "keys", F.monotonically_increasing_id().alias("set")))
    owner = checkpointed(features.select("id", "n", "digest").join(merged.select("digest", "n", "set"), ["digest", "n"], "left").select("id", "n", "set"))
    # Counts are combined before the shuffle, so that a key of very many documents is no load of one task.
    keyed = merged.select(F.explode("keys").alias("key"), F.col("set").alias("id")).distinct()
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("head")).where("size > 1")
    buckets = checkpointed(keyed.join(sizes, "key").select("key", "id", "size", "head"))
    # Only texts that share a table with another one are moved from here on, one for each set.
    shared = merged.join(buckets.select(F.col("id").alias("set")).distinct(), "set").select("id", "row", "set")
    texts = rows.join(shared, ["id", "row"]).dropDuplicates(["id", "row"])
    texts = checkpointed(texts.select(F.col("set").alias("id"), "text"))

    pairs = buckets.where("head < id").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    one_id = owner.where("set is not null and id is not null").groupBy("id").agg(F.min("set").alias("a"), F.max("set").alias("z")).where("a < z")
    one_id = owner.join(one_id, "id").where("set <> a").select("a", F.col("set").alias("b")).distinct()
    links = checkpointed(confirmed(pairs, texts).unionByName(one_id))
    labels = components(links)

    # Buckets of two are settled. In larger ones, members of several components may still have to meet.
    larger, own = buckets.where("size > 2").select("key", "id"), None
    for last in (False, True):
        labelled = larger.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("label"))
        counts = labelled.groupBy("key", "label").agg(F.count("*").alias("k"), F.min_by("id", F.xxhash64("key", "id")).alias("pivot"))
        most = counts.groupBy("key").agg(F.count("*").alias("labels"), F.max(F.struct("k", "label", "pivot")).alias("top")).where("labels > 1")
        open_ = checkpointed(labelled.join(most.select("key", F.col("top.label").alias("most"), F.col("top.pivot").alias("pivot")), "key"))
        if open_.isEmpty():
            break
        if own is None:
            own = checkpointed(profiles(open_.select("id").distinct(), texts, merged.select(F.col("set").alias("id"), "n")))
        if last:
            met = reaching(open_, own)
        else:
            met = open_.where("label <> most").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
        met = checkpointed(met.join(pairs, ["a", "b"], "left_anti"))
        if not met.isEmpty():
            links = checkpointed(links.unionByName(judged(met, own)))
            labels = components(links)
    # A set's component goes by the smallest doc_id of the component's sets.
    of_set = merged.select("set", "id").join(labels.withColumnRenamed("id", "set"), "set", "left").select("set", "id", F.coalesce("component", "set").alias("top"))
    names = of_set.groupBy("top").agg(F.min("id").alias("component"))
    of_set = of_set.join(names, "top").select("set", "component")
    return owner.join(of_set, "set", "left").select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document (the one of the smallest id) of each component."""
    gone = classes(docs, id_col, text_col).where("component <> id").select("id").distinct()
    return boxed(docs, id=named(id_col).cast("long")).join(gone, "id", "left_anti").select("box.*")
