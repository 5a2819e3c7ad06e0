"""Exact top-k search by inner product, with multi-resolution segment statistics.

A vector is cut into equal segments at several resolutions. With m the mean and d the standard deviation of a segment
of length l, Cauchy-Schwarz on what is left after the means gives

    q.x <= sum over segments of l * (m_q * m_x + d_q * d_x),

the inner-product form of the lower bound on a Euclidean distance by segment means and deviations; segments of one
component add their product. The bounds are computed for whole blocks as matrix products, coarse to fine: an eighth, a
half and three quarters as many segments as components. Only candidates whose bound still reaches the query's floor are compared
exactly, in integers. The floor is the k-th best score found so far; it begins with the k-th best score among a bounded
sample of candidates (about `FLOOR_SAMPLE` ids, those of the least hashes), searched first, so that bounds decide from the first block
on. The sample changes what is compared, never what is found: any k candidates' least score is a lower bound of the k-th best.

Queries and candidates are rows alike. Queries are dealt into groups of at most about `QUERY_GROUP` x `GROUPS_HELD`, candidates
into chunks, and one job works all cells (group, chunk): a task takes in its cell's queries first, then streams the
chunk's candidates past them and gives each query's best k of the chunk. What a task holds does not grow with the tables,
and neither queries nor candidates pass the driver. With one group, each candidate is moved once.

Defined results: null vectors and vectors with a null, NaN or infinite component take no part; vectors are compared
only with queries of the same length; ties go to the smaller id; a query repeated under one id counts once (its
smallest vector); a repeated candidate row counts as often as it stands; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import named

#: Queries that are compared with a block of candidates at once, and the number of such groups that a task holds.
QUERY_GROUP = 4096
GROUPS_HELD = 8
#: Segments of each level as shares of the number of components. On vectors without any structure (as those of the test
#: data) the first two keep nearly all and four tenths of the pairs, the last one a twentieth.
LEVELS = (1 / 8, 1 / 2, 3 / 4)
CANDIDATE_BLOCK = 2048
#: About so many candidates are searched first, for the floors.
FLOOR_SAMPLE = 4096

PARTIAL = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component as a long array; null if the vector is null or has a null or non-finite one."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def _segments(v: np.ndarray, share: float) -> np.ndarray:
    """Rows of sqrt(l) * mean and sqrt(l) * deviation of each segment, so that a product of two rows is the bound."""
    n = v.shape[1]
    edges = np.unique(np.linspace(0, n, max(1, round(n * share)) + 1).astype(int))
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        part = v[:, a:b]
        out.append(part.mean(axis=1) * np.sqrt(b - a))
        if b - a > 1:
            out.append(part.std(axis=1) * np.sqrt(b - a))
    return np.stack(out, axis=1)


class _Queries:
    """One length of vector: queries, their statistics, and the best k found so far by this task."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, floors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        wide = vectors.astype(np.float64)
        self.levels = [_segments(wide, share) for share in LEVELS]
        self.norms = np.sqrt((wide**2).sum(axis=1))
        n = len(ids)
        self.least = floors
        self.best = np.full((n, k), np.iinfo(np.int64).min)
        self.best_id = np.full((n, k), np.iinfo(np.int64).max)
        self.count = np.zeros(n, np.int64)
        self.pairs = self.exact = 0  # offered, and compared exactly

    def floor(self) -> np.ndarray:
        return np.maximum(self.least, np.where(self.count >= self.k, self.best[:, -1], np.iinfo(np.int64).min))

    def offer(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        wide = vectors.astype(np.float64)
        floor = self.floor().astype(np.float64)
        # The bounds are rounded doubles: they get a margin far above the rounding error.
        margin = 1 + 1e-9 * self.norms[:, None] * np.sqrt((wide**2).sum(axis=1))[None, :]
        keep = np.ones((len(self.ids), len(ids)), bool)
        for level, share in enumerate(LEVELS):
            stats = _segments(wide, share)
            if 4 * np.count_nonzero(keep) > keep.size:  # most are left: one product is cheaper than gathered rows
                keep &= self.levels[level] @ stats.T + margin >= floor[:, None]
                continue
            q, c = np.nonzero(keep)
            for a in range(0, len(q), 200_000):
                i, j = q[a : a + 200_000], c[a : a + 200_000]
                keep[i, j] = np.einsum("ij,ij->i", self.levels[level][i], stats[j]) + margin[i, j] >= floor[i]
        keep &= self.ids[:, None] != ids[None, :]
        self.pairs, self.exact = self.pairs + keep.size, self.exact + int(np.count_nonzero(keep))
        q, c = np.nonzero(keep)
        if not len(q):
            return
        scores = np.concatenate([np.einsum("ij,ij->i", self.vectors[q[a : a + 200_000]], vectors[c[a : a + 200_000]]) for a in range(0, len(q), 200_000)])
        near = scores >= self.floor()[q]
        self._merge(q[near], ids[c[near]], scores[near])

    def _merge(self, q: np.ndarray, found: np.ndarray, scores: np.ndarray) -> None:
        """Scores of queries (by place) with the ids found, put among their best."""
        if not len(q):
            return
        hit = np.unique(q)
        old = np.repeat(hit, self.k)
        old_real = (np.arange(self.k)[None, :] < self.count[hit][:, None]).ravel()
        all_q = np.concatenate([old[old_real], q])
        all_s = np.concatenate([self.best[hit].ravel()[old_real], scores])
        all_i = np.concatenate([self.best_id[hit].ravel()[old_real], found])
        order = np.lexsort((all_i, -all_s, all_q))
        all_q, all_s, all_i = all_q[order], all_s[order], all_i[order]
        first = np.r_[True, all_q[1:] != all_q[:-1]]
        rank = np.arange(len(all_q)) - np.maximum.accumulate(np.where(first, np.arange(len(all_q)), 0))
        top = rank < self.k
        self.best[hit], self.best_id[hit] = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        self.best[all_q[top], rank[top]], self.best_id[all_q[top], rank[top]] = all_s[top], all_i[top]
        self.count[hit] = np.minimum(self.k, np.bincount(np.searchsorted(hit, all_q), minlength=len(hit)))

    def found(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        real = np.arange(self.k)[None, :] < self.count[:, None]
        yield np.repeat(self.ids, self.k).reshape(real.shape)[real], self.best_id[real], self.best[real]


class _Cell:
    """The queries of one cell, by length of their vectors, and then its candidates."""

    def __init__(self, k: int, query_group: int) -> None:
        self.k, self.query_group = k, query_group
        self.waiting: dict[int, list[tuple[np.ndarray, ...]]] = {}
        self.held: dict[int, list[_Queries]] = {}

    def take(self, kind: int, ids: np.ndarray, lists: pa.ListArray, floors: np.ndarray) -> None:
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        sizes = np.diff(offsets)
        for n in np.unique(sizes) if kind == 0 else list({**self.waiting, **self.held}):
            rows = np.flatnonzero(sizes == n)
            if not len(rows):
                continue
            if kind == 0:
                self.waiting.setdefault(int(n), []).append((ids[rows], flat[offsets[rows][:, None] + np.arange(n)[None, :]], floors[rows]))
                continue
            if n in self.waiting:
                every = [np.concatenate(c) for c in zip(*self.waiting.pop(n))]
                self.held[n] = [_Queries(*(c[a : a + self.query_group] for c in every), self.k) for a in range(0, len(every[0]), self.query_group)]
            for q in self.held[n]:
                # Without floors everything is compared: a few candidates make some.
                first = 0 if q.pairs or q.least.min(initial=0) > np.iinfo(np.int64).min else 8 * self.k
                edges = [0, *range(min(first, len(rows)), len(rows), CANDIDATE_BLOCK), len(rows)]
                for a, z in zip(edges, edges[1:]):
                    if a < z:
                        q.offer(ids[rows[a:z]], flat[offsets[rows[a:z]][:, None] + np.arange(n)[None, :]])

    def found(self) -> Iterator[pa.RecordBatch]:
        for q in (q for same in self.held.values() for q in same):
            for columns in q.found():
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=PARTIAL)


def _searcher(k: int, query_group: int):
    """Rows come by cell, a cell's queries (kind 0) first."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell = None, _Cell(k, query_group)
        for part in parts:
            where = part.column(0).to_numpy(zero_copy_only=False)
            kind = part.column(1).to_numpy(zero_copy_only=False)
            ids = part.column(2).to_numpy(zero_copy_only=False)
            floors = part.column(4).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]) | (kind[1:] != kind[:-1])]) if len(where) else []
            for a, z in zip(edges, [*edges[1:], len(where)]):
                if where[a] != now:
                    yield from cell.found()
                    now, cell = where[a], _Cell(k, query_group)
                cell.take(int(kind[a]), ids[a:z], part.column(3).slice(a, z - a), floors[a:z])
        yield from cell.found()

    return run


def _searched(queries: DataFrame, candidates: DataFrame, groups: int, chunks: int, k: int) -> DataFrame:
    """query_id, vec_id, score: the best k of each chunk of candidates (id, v) for each query (id, v, floor)."""
    # Candidates are dealt round by row number, so that a row that is repeated very often lies in all chunks.
    dealt = queries.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("group"), F.lit(0).alias("kind"), "id", "v", "floor")
    rows = candidates.select(F.pmod(F.monotonically_increasing_id(), F.lit(chunks)).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).alias("kind"), "id", "v", F.lit(None).cast("long").alias("floor"))
    cells = dealt.unionByName(rows).select((F.col("group") * chunks + F.col("chunk")).alias("cell"), "kind", "id", "v", "floor")
    return cells.repartitionById(groups * chunks, F.col("cell")).sortWithinPartitions("cell", "kind").mapInArrow(_searcher(k, QUERY_GROUP), "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query row with all other rows."""
    ready = vectors.select(named(id_col).cast("long").alias("id"), quantised(named(vector_col), scale).alias("v"), is_query.alias("q"))
    ready = ready.where("id is not null and v is not null and size(v) > 0")
    queries = ready.where("q").groupBy("id").agg(F.min("v").alias("v"))
    size = ready.agg(F.count(F.lit(1)).alias("rows"), F.count_if("q").alias("queries")).head()
    groups = max(1, -(-size.queries // (QUERY_GROUP * GROUPS_HELD)))
    chunks = max(1, -(-vectors.sparkSession.sparkContext.defaultParallelism // groups))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    # A share of the ids by their hashes; an id that is repeated very often counts once.
    share = min(1.0, FLOOR_SAMPLE / max(1, size.rows))
    sample = ready.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).groupBy("id").agg(F.min("v").alias("v"))
    first = _searched(queries.withColumn("floor", F.lit(None).cast("long")), sample, groups, 1, k)
    floors = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    partial = _searched(queries.join(floors, "id", "left"), ready, groups, chunks, k)
    # The best of each chunk meet here: at most k rows from a chunk for each query.
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
