"""Ranked lexical search, reversed: the items are indexed, the documents stream past the index.

The items' distinct terms become an inverted index (term -> items and how often the term stands in each). It is broadcast
in blocks of at most `MOST_POSTINGS` (term, item) pairs; an item with more pairs than that is a block of its own, which is
bounded by its one text. For each block the documents are read once: a task counts a document's terms and keeps those of
the index, with the number of all its terms. That table (document, number of terms, term numbers, counts) goes to the
shared checkpoint folder. From it come the number of documents, of all terms and of the documents of each term (partial
sums before the shuffle), and so the terms' weights. Then it streams through the index: every (document, term) adds its
share to the items of the term's posting list, and each task keeps the k best documents of each item in a bounded heap.
Heaps are merged in two rounds, first within groups of tasks, so that no task takes in more than about k times the square
root of the number of tasks for an item.

Scores are whole numbers. With N documents of at least one term, L terms in all, n in a document, df documents of a term
and tf occurrences in a document: w = floor(1000 ln((2N+2)/(2df+1))), m = 75 + (25 n N) div L, and a document's score for
an item is the sum over the item's terms, repeats included, of w ((10^9 tf) div (1000 tf + 12 m)). Products of 64-bit
size are taken as Python's whole numbers once a document; sums are added as doubles below 2^53 and as whole numbers above.

Defined results: null text (of items too) has no terms; an item without terms, or without a document of score above 0, has
no rows; items repeated under one id count once, with the least text; a null item id is an id; each row of documents is a
document of its own, also under a repeated id; a null document id stands before all others among equal scores; empty
tables give no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import batches, checkpointed, column_of, named

MOST_POSTINGS = 500_000
#: Cells (document, item) that a task scores at once.
CELLS = 2_000_000

#: Bytes of UTF-8 that stand between terms become blanks, A-Z become small, all others stay: split() gives the terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))

COUNTS = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])
COUNTS_DDL = "doc long, n long, terms array<int>, tfs array<int>"
FOUND = pa.schema([("item", pa.int32()), ("task", pa.int32()), ("doc", pa.int64()), ("score", pa.int64())])
FOUND_DDL = "item int, task int, doc long, score long"


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _item_terms(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("item", pa.int64()), ("term", pa.binary()), ("times", pa.int64())])

    def rows() -> Iterator[tuple]:
        for part in parts:
            for item, text in zip(column_of(part, "item"), column_of(part, "text")):
                for term, times in Counter(terms_of(text)).items():
                    yield item, term, times

    yield from batches(rows(), schema)


def _counter(numbers):
    """Documents' counts of the terms that are in the index."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbers.value.get

        def rows() -> Iterator[tuple]:
            for part in parts:
                for doc, text in zip(column_of(part, "id"), column_of(part, "text")):
                    terms = terms_of(text)
                    if not terms:
                        continue
                    held = Counter(map(number, terms))
                    held.pop(None, None)
                    yield doc, len(terms), list(held), list(held.values())

        yield from batches(rows(), COUNTS, 1000)

    return run


class Heaps:
    """The k best documents of every item: higher scores first, then smaller ids, null ids foremost."""

    def __init__(self, items: int, k: int) -> None:
        self.k = k
        self.score = np.zeros((items, k), np.int64)  # 0: empty
        self.doc = np.zeros((items, k), np.int64)
        self.named = np.ones((items, k), bool)  # False: the id is null

    def offer(self, doc: np.ndarray, is_named: np.ndarray, scores: np.ndarray) -> None:
        """scores: a row a document, a column an item."""
        d, i = np.nonzero((scores > 0) & (scores >= self.score[:, -1]))
        s = scores[d, i]
        # At the score of an item's last place only a smaller id gets in; of very many equal ones the others go at once.
        less = (s > self.score[i, -1]) | (is_named[d] < self.named[i, -1]) | ((is_named[d] == self.named[i, -1]) & (doc[d] < self.doc[i, -1]))
        d, i, s = d[less], i[less], s[less]
        if not len(d):
            return
        hit = np.unique(i)
        old_i, old_p = np.nonzero(self.score[hit] > 0)
        old_i = hit[old_i]
        item = np.r_[old_i, i]
        score = np.r_[self.score[old_i, old_p], s]
        name = np.r_[self.named[old_i, old_p], is_named[d]]
        ids = np.r_[self.doc[old_i, old_p], doc[d]]
        order = np.lexsort((ids, name, -score, item))
        item, score, name, ids = item[order], score[order], name[order], ids[order]
        begin = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        place = np.arange(len(item)) - np.repeat(begin, np.diff(np.r_[begin, len(item)]))
        top = place < self.k
        self.score[hit] = 0
        at = item[top], place[top]
        self.score[at], self.named[at], self.doc[at] = score[top], name[top], ids[top]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """item, document id, whether it is not null, and score."""
        i, p = np.nonzero(self.score > 0)
        return i, self.doc[i, p], self.named[i, p], self.score[i, p]


class Index:
    """Posting lists of one block: for term t, items[begin[t]:begin[t + 1]] and how often the term stands in them."""

    def __init__(self, begin: np.ndarray, items: np.ndarray, times: np.ndarray, weights: np.ndarray, n_items: int, n_docs: int, n_terms: int) -> None:
        self.begin, self.items, self.times, self.weights = begin, items, times, weights
        self.n_items, self.n_docs, self.n_terms = n_items, n_docs, n_terms
        self.most = int(times.max(initial=0)) * int(weights.max(initial=0)) * 1_000_000

    def scores(self, n: list[int], terms: np.ndarray, tfs: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Scores of documents (rows) for all items (columns). owner: the document, by place, of each (term, tf)."""
        m = np.array([75 + 25 * x * self.n_docs // self.n_terms for x in n], np.int64)
        tf = tfs.astype(np.int64)
        share = self.weights[terms] * (1_000_000_000 * tf // (1000 * tf + 12 * m[owner]))
        size = self.begin[terms + 1] - self.begin[terms]
        entry = np.repeat(self.begin[terms] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        key = np.repeat(owner, size) * self.n_items + self.items[entry]
        added = np.repeat(share, size) * self.times[entry]
        cells = len(n) * self.n_items
        # A document has at most all terms of the index.
        if self.most * max(1, int(np.bincount(owner, minlength=1).max())) < 2**53:
            return np.bincount(key, weights=added, minlength=cells).astype(np.int64).reshape(len(n), self.n_items)
        out = np.zeros(cells, np.int64)
        np.add.at(out, key, added)
        return out.reshape(len(n), self.n_items)


def _searcher(index, k: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Index = index.value
        heaps = Heaps(held.n_items, k)
        step = max(1, CELLS // held.n_items)
        for whole in parts:
            for a in range(0, whole.num_rows, step):
                part = whole.slice(a, step)
                doc, lists = part.column(0), [part.column(c) for c in (2, 3)]
                terms, tfs = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
                owner = np.repeat(np.arange(part.num_rows), np.diff(lists[0].offsets.to_numpy()))
                scores = held.scores(part.column(1).to_pylist(), terms, tfs, owner)
                heaps.offer(doc.fill_null(0).to_numpy(), doc.is_valid().to_numpy(zero_copy_only=False), scores)
        context = TaskContext.get()
        item, doc, is_named, score = heaps.rows()
        task = np.full(len(item), context.partitionId() if context else 0, np.int32)
        columns = [pa.array(item.astype(np.int32)), pa.array(task), pa.array(doc, mask=~is_named), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, schema=FOUND)

    return run


def _best(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_first("doc"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """item, doc, score, rank; terms: item, term, times of one block, which fits the driver (see item_blocks)."""
    spark = docs.sparkSession
    rows = terms.toArrow()
    term_values, times = rows.column("term").combine_chunks().dictionary_encode(), rows.column("times").to_numpy()
    term_no = term_values.indices.to_numpy()
    item_ids, item_no = np.unique(rows.column("item").to_numpy(), return_inverse=True)
    vocabulary = term_values.dictionary.to_pylist()
    order = np.argsort(term_no, kind="stable")
    begin = np.searchsorted(term_no[order], np.arange(len(vocabulary) + 1))
    numbers = spark.sparkContext.broadcast({term: i for i, term in enumerate(vocabulary)})
    picked = docs.select("id", "text").mapInArrow(_counter(numbers), COUNTS_DDL)
    counts = checkpointed(picked)
    total = counts.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).head()
    if not total.docs:
        return spark.createDataFrame([], "item long, doc long, score long, rank int")
    # A row for each term of the block at most.
    df = {r.term: r.df for r in counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    weights = np.array([weight(total.docs, df.get(t, 0)) for t in range(len(vocabulary))], np.int64)
    index = Index(begin, item_no[order], times[order].astype(np.int64), weights, len(item_ids), total.docs, total.terms)
    found = counts.mapInArrow(_searcher(spark.sparkContext.broadcast(index), k), FOUND_DDL)
    groups = max(1, math.isqrt(counts.rdd.getNumPartitions()))
    found = _best(found.withColumn("part", F.pmod("task", F.lit(groups))), ["item", "part"], k).drop("rank")
    found = _best(found, ["item"], k)
    ids = spark.createDataFrame(list(enumerate(item_ids.tolist())), "item int, item_id long")
    return found.join(ids, "item").select(F.col("item_id").alias("item"), "doc", "score", "rank")


def item_blocks(sizes: DataFrame, most: int) -> tuple[DataFrame, int]:
    """sizes (item, pairs) with the block of each item, and the number of blocks: items are dealt by a hash of their number into so many
    blocks that none with several items has more than most pairs."""
    total = sizes.agg(F.sum("pairs")).head()[0] or 0
    blocks = max(1, -(-total // most))
    while True:
        dealt = sizes.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
        if blocks == 1 or dealt.groupBy("block").agg(F.sum("pairs").alias("pairs"), F.count(F.lit(1)).alias("items")).where(f"pairs > {most} and items > 1").isEmpty():
            return dealt, blocks
        blocks *= 2


def search(docs: DataFrame, items: DataFrame, k: int = 20, most_postings: int = MOST_POSTINGS, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest scores above 0 for each item."""
    spark = docs.sparkSession
    ready = docs.select(named(doc_id).cast("long").alias("id"), named(text_col).alias("text"))
    # Ids of items may be null: they get numbers.
    texts = items.select(named(item_id).cast("long").alias("item_id"), named(text_col).alias("text")).groupBy("item_id").agg(F.min("text").alias("text"))
    texts = checkpointed(texts.withColumn("item", F.monotonically_increasing_id()))
    terms = checkpointed(texts.select("item", "text").mapInArrow(_item_terms, "item long, term binary, times long"))
    dealt, blocks = item_blocks(terms.groupBy("item").agg(F.count(F.lit(1)).alias("pairs")), most_postings)
    out = spark.createDataFrame([], "item long, doc long, score long, rank int")
    for block in [r.block for r in dealt.select("block").distinct().collect()] if blocks > 1 else [0]:
        chosen = terms if blocks == 1 else terms.join(dealt.where(F.col("block") == block).select("item"), "item")
        out = out.unionByName(_search_block(ready, chosen, k))
    return out.join(texts.select("item", "item_id"), "item").select("item_id", "rank", F.col("doc").alias("doc_id"), "score")
