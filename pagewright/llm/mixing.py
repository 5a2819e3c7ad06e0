"""Mixing of sources to target weights by a multivariate-hypergeometric splitting tree over blocks.

Sizes are words. Each source's documents are dealt into blocks by a hash of their id, and its blocks are permuted by
another hash. A source whose target is r times its size takes its blocks floor(r) times whole, then a further pass ends
in the block that crosses the target. So every source has an exact block quota.
The quotas are split among the output shards by a binary tree: at each node the left half's share of blocks is one draw
from the multivariate hypergeometric distribution of the node's quotas, the right half gets the rest. A leaf is a shard's
quota of each source; the shard draws that many next blocks in the permuted order, so that the draws of shards are
disjoint, and a document is in the mix as often as shards drew its block. Its documents are shuffled locally by a hash.
Of the last block drawn from a source, which crosses the target, those documents are taken that fit before the target,
in hash order, and the smallest of its others up to the target; a large block is cut by a further hash, so that only the
part that crosses is ordered.

Bounds: a source has at most `most_blocks` blocks, and a block that many parts, which windows can sort; only one row per
source (its name, size and number of blocks) reaches the driver, where weights have to be assigned anyway, and the draws
travel back as one row per source. Documents never do.

Defined results: null text has size 0; the null source comes last; sources of size 0 have target 0; repeated rows
count and are taken each for itself; a document is taken twice at most; an empty table gives no rows. Everything
follows from hashes and the seed, so reruns agree whatever the partitions are. In mix(), the rows of one id are alike:
all get the copies of the row that got most; columns of any name stay as they are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import WORD, boxed, checkpointed, named

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
BLOCK_WORDS = 65_536
MOST_BLOCKS = 16_384
SHARDS = 64
SUB_SHARDS = 8


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], total: float, most: float = MOST_REPEATS) -> list[float]:
    """Shares of total by weight; a share stops at most * size and its excess is dealt again by weight."""
    out = [0.0] * len(sizes)
    open_, left = list(range(len(sizes))), float(total)
    while open_ and left > 0:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit >= most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """shards x sources: exact quotas of each shard, by halving; a half's number of blocks follows its shards."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    n = int(round(int(quotas.sum()) * left / shards))
    drawn = rng.multivariate_hypergeometric(quotas, n) if quotas.sum() else quotas
    return np.concatenate([split_quotas(drawn, left, rng), split_quotas(quotas - drawn, shards - left, rng)])


def drawn_blocks(sized: DataFrame, names: list, shards: int, seed: int) -> DataFrame:
    """sized (source, block, words, source_size, target) with place and before in the permuted order, and draws: the
    shard of each time that the block is drawn; crosses: whether its last draw is the one that crosses the target."""
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "block"), "block")
    sized = sized.withColumn("place", F.row_number().over(order) - 1).withColumn("before", F.sum("words").over(order) - F.col("words"))
    passes = F.least(F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)) + 1e-12), F.lit(MOST_REPEATS))
    sized = sized.withColumn("full", F.when(F.col("source_size") > 0, passes).otherwise(0))
    sized = sized.withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    further = (F.col("full") < MOST_REPEATS) & (F.col("before") < F.col("rest"))
    sized = checkpointed(sized.withColumn("crosses", further & (F.col("before") + F.col("words") > F.col("rest"))).withColumn("further", further))
    quota_rows = sized.groupBy("source").agg(F.count("*").alias("b"), F.sum(F.col("full") + F.col("further").cast("int")).alias("quota")).collect()
    of = {r.source: r for r in quota_rows}
    quotas = np.array([int(of[n].quota) if n in of else 0 for n in names], np.int64)
    leaves = split_quotas(quotas, shards, np.random.default_rng(seed)) if len(names) else np.zeros((shards, 0), np.int64)
    ends = [(n, int(of[n].b), [int(x) for x in leaves[:, i].cumsum()]) for i, n in enumerate(names) if n in of]
    ends = sized.sparkSession.createDataFrame(ends, "s string, b long, ends array<long>")
    # A source's draws are numbered pass by pass; the leaves' running sums tell the shard of a number, or that it has none.
    numbers = F.transform(F.sequence(F.lit(0), F.lit(MOST_REPEATS - 1)), lambda p: p * F.col("b") + F.col("place"))
    shard_of = F.transform(numbers, lambda n: F.size(F.filter("ends", lambda e: e <= n)).cast("int"))
    draws_ = F.filter(shard_of, lambda x: x < shards)
    return sized.join(ends, sized.source.eqNullSafe(ends.s)).select("source", "block", "words", "before", "rest", "crosses", draws_.alias("draws"))


def _crossing(rows: DataFrame, block_words: int, most_blocks: int, seed: int) -> DataFrame:
    """rows of blocks that cross their target, with also: whether the document is taken in the last draw."""
    sub = F.pmod(F.xxhash64(F.lit(seed + 5), "id"), F.greatest(F.lit(1), F.least(F.lit(most_blocks), F.floor(F.col("words") / block_words))))
    rows = rows.withColumn("sub", sub)
    subs = rows.groupBy("source", "sub", F.col("before").alias("start")).agg(F.sum("size").alias("n"))
    order = Window.partitionBy("source").orderBy("sub")
    subs = subs.select(F.col("source").alias("s"), F.col("sub").alias("k"), "n", (F.col("start") + F.sum("n").over(order) - F.col("n")).alias("sub_before"))
    rows = rows.join(subs, rows.source.eqNullSafe(subs.s) & (rows["sub"] == subs.k)).drop("s", "k")
    whole = F.col("sub_before") + F.col("n") <= F.col("rest")
    cut = rows.where(~whole & (F.col("sub_before") < F.col("rest")))
    inner = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 2), "id"), "id", "size")
    cut = cut.withColumn("fits", F.col("sub_before") + F.sum("size").over(inner) <= F.col("rest"))
    used = F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0)).over(Window.partitionBy("source"))
    cut = cut.withColumn("gap", F.col("rest") - F.col("sub_before") - used)
    others = Window.partitionBy("source", "fits").orderBy("size", F.xxhash64(F.lit(seed + 2), "id"), "id")
    cut = cut.withColumn("also", F.col("fits") | (F.sum("size").over(others) - F.col("size") / 2 <= F.col("gap"))).drop("fits", "gap")
    return cut.unionByName(rows.where(whole | (F.col("sub_before") >= F.col("rest"))).withColumn("also", whole))


def draws(docs: DataFrame, seed: int = 7, weights: tuple = WEIGHTS, share: float = SHARE, block_words: int = BLOCK_WORDS, most_blocks: int = MOST_BLOCKS, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, block, size, source_size, target, copies, shards: a row per document; shards holds the shard of each copy."""
    spark = docs.sparkSession
    rows = docs.select(named(id_col).alias("id"), named(source_col).cast("string").alias("source"), n_words(named(text_col)).alias("size"))
    rows = checkpointed(rows)  # texts are read once
    by_source = rows.groupBy("source").agg(F.sum("size").alias("n")).collect()
    by_source.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8", "surrogatepass")))
    sizes = [int(r.n) for r in by_source]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes))
    blocks = [max(1, min(-(-n // block_words), most_blocks)) for n in sizes]
    plan = [(r.source, n, float(t), b) for r, n, t, b in zip(by_source, sizes, goal, blocks)]
    # Spark broadcasts the plan where its size allows; with very many sources it is joined by shuffle.
    plan = spark.createDataFrame(plan, "s string, source_size long, target double, n_blocks long")
    rows = rows.join(plan, rows.source.eqNullSafe(plan.s)).drop("s")
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "source", "id"), F.col("n_blocks")))
    sized = rows.groupBy("source", "block", "source_size", "target").agg(F.sum("size").alias("words"))
    sized = drawn_blocks(sized, [r.source for r in by_source], shards, seed)
    sized = sized.withColumnsRenamed({"source": "s", "block": "k"})
    rows = rows.join(sized, rows.source.eqNullSafe(sized.s) & (rows.block == sized.k)).drop("s", "k", "n_blocks")
    last = _crossing(rows.where("crosses"), block_words, most_blocks, seed)
    rows = rows.where("not crosses").withColumn("also", F.lit(True)).unionByName(last, allowMissingColumns=True)
    taken = F.when(F.col("also"), F.col("draws")).otherwise(F.slice("draws", 1, F.size("draws") - 1))
    return rows.select("id", "source", "block", "size", "source_size", "target", taken.alias("shards")).withColumn("copies", F.size("shards"))


def mix(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The documents of the mix, repeats included, in shuffled shards, with docs' columns as they were.

    A shard lies in SUB_SHARDS partitions; within each, rows follow a hash of id and copy.
    """
    taken = draws(docs, seed, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    taken = taken.where("copies > 0").groupBy(F.col("id").alias("taken_id")).agg(F.max("shards").alias("shards"))
    boxes = boxed(docs, id=named(id_col))
    copies = boxes.join(taken, boxes.id.eqNullSafe(taken.taken_id)).select("box", "id", F.posexplode("shards").alias("copy", "shard"))
    copies = copies.withColumn("key", F.xxhash64(F.lit(seed + 3), "id", "copy")).withColumn("sub", F.pmod(F.xxhash64(F.lit(seed + 4), "id", "copy"), F.lit(SUB_SHARDS)))
    return copies.repartition("shard", "sub").sortWithinPartitions("shard", "key").select("box.*")
