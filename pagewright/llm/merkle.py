"""Merkle manifest of a table: a leaf a row, a tree a group, one root, and a proof for every row.

H is the lower-case hex SHA-256; several inputs are put together first, digests as their hex text. A leaf is H of the
row's fields, each `-` if null, else its number of UTF-8 bytes, `:` and its value. In a group leaves stand in ascending
order of their id; every 8 nodes in a row (the last run may be shorter) have their H as parent, as long as there are
several nodes. The last nodes of the groups, in ascending order of the group (null first), are the leaves of a tree of
the same kind, whose last node is the root.

Places come from one sort by ranges: rows are numbered within their range, and counts of (range, group) give what lies
before. Then each level is one window over its runs: lag and lead columns at the offsets 1 to 7, masked by the row's slot
in the run and by the run's length, are its siblings on the left and on the right, and the rows of slot 0 hash the parents. On
the way down a node's proof is its siblings followed by its parent's proof, so a level meets the one above by a join.
Runs have at most 8 rows, so no window, sort or join key grows with the table, a group or a hot id. Only digests and ids
are shuffled, never texts. Each level is an eighth of the one below; it is kept in the shared checkpoint folder.

Defined results: null ids come first in their group; rows of equal id stand in the order of their leaves, rows that are
wholly equal are leaves of their own in any order; a null group is a group; an empty table has no root and no rows.
Columns that are no field are not read. With one row, the leaf is the root and its proof is H of the empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import checkpointed, named

WIDTH = 8
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def field(value: Column) -> Column:
    """A leaf's part for one value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with place (from 0 in its group, by order) and n (rows of the group). group must not be null; rows has no
    columns place, n, at, task, first or before."""
    dealt = rows.withColumn("at", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(group, *order, "at").sortWithinPartitions(group, *order, "at").drop("at")
    # In a sorted range, the low bits of the id number the rows one by one.
    kept = checkpointed(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("task", F.shiftright("at", 33).cast("int")))
    counts = kept.groupBy(group, "task").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    # A row for each range and each group in it: no more than ranges and groups together.
    earlier = F.sum("rows").over(Window.partitionBy(group).orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(group, "task", "first", F.coalesce(earlier, F.lit(0)).alias("before"), F.sum("rows").over(Window.partitionBy(group)).alias("n"))
    return kept.join(counts, [group, "task"]).withColumn("place", F.col("before") + F.col("at") - F.col("first")).drop("before", "at", "first", "task")


def siblings(nodes: DataFrame) -> DataFrame:
    """nodes (group, place, n, digest, ..) with the digests on the left and on the right in the same run as texts."""
    run, slot = F.floor(F.col("place") / WIDTH).cast("long"), F.pmod("place", F.lit(WIDTH)).cast("int")
    nodes = nodes.select("*", run.alias("run"), slot.alias("slot"), F.least(F.lit(WIDTH), F.col("n") - run * WIDTH).cast("int").alias("length"))
    order = Window.partitionBy("group", "run").orderBy("slot")
    before = [F.when(F.col("slot") >= k, F.lag("digest", k).over(order)) for k in range(WIDTH - 1, 0, -1)]
    after = [F.when(F.col("slot") + k < F.col("length"), F.lead("digest", k).over(order)) for k in range(1, WIDTH)]
    return nodes.select("*", F.concat_ws("", *before).alias("left"), F.concat_ws("", *after).alias("right"))


def levels_above(leaves: DataFrame) -> list[DataFrame]:
    """The levels of the trees of all groups, from the one above leaves (group, place, n, digest) up. A group ends at the
    level where it has one node."""
    out = []
    below = leaves.select("group", "place", "n", "digest")
    most = leaves.agg(F.max("n")).head()[0] or 0
    while most > 1:
        parents = siblings(below.where("n > 1")).where("slot = 0")
        below = checkpointed(parents.select("group", F.col("run").alias("place"), F.ceil(F.col("n") / WIDTH).cast("long").alias("n"), _digest(F.concat("digest", "right")).alias("digest")))
        out.append(below)
        most = -(-most // WIDTH)
    return out


def proved(nodes: DataFrame, parents: DataFrame, keep: list[str], carry: list[str]) -> DataFrame:
    """keep of nodes, carry of their parents, and path: the siblings of the node and of all nodes above it as structs
    (left, right). parents: group, place, path, ..; a group whose only node is here has it at place 0, with the path from there."""
    above = parents.select(F.col("group").alias("parent_group"), F.col("place").alias("parent_place"), F.col("path").alias("parent_path"), *carry)
    own = F.when(F.col("n") > 1, F.array(F.struct("left", "right"))).otherwise(F.array().cast("array<struct<left:string,right:string>>"))
    met = siblings(nodes).join(above, (F.col("group") == F.col("parent_group")) & (F.col("run") == F.col("parent_place")))
    return met.select(*keep, *carry, F.concat(own, "parent_path").alias("path"))


def _descended(levels: list[DataFrame], tops: DataFrame, carry: list[str]) -> DataFrame:
    """group, place, carry and path of the lowest of levels; tops: group, carry and path of the groups' last nodes, which
    stand at any level."""
    above = None
    for level in reversed(levels):
        ended = level.where("n = 1").join(tops, ["group", "place"]).select("group", "place", *carry, "path")
        above = ended if above is None else proved(level.where("n > 1"), above, ["group", "place"], carry).unionByName(ended)
    return above


def manifest(leaves: DataFrame) -> DataFrame:
    """leaves: group (a text or null), id, digest, and any columns whose names are none of this module's.

    Returns these columns but group, with subroot, root and path (the proof: siblings left and right, from the leaf to the root).
    """
    # Null is the empty text and sorts before all others, which get a mark in front.
    marked = leaves.withColumn("group", F.coalesce(F.concat(F.lit("+"), F.col("group")), F.lit("")))
    rows = numbered(marked, "group", ["id", "digest"])
    levels = levels_above(rows)
    lone = rows.where("n = 1").select("group", "digest")
    ends = lone
    for level in levels:
        ends = ends.unionByName(level.where("n = 1").select("group", "digest"))
    # The tree over groups: one group whose leaves are the groups.
    over = numbered(ends.select(F.lit("").alias("group"), F.col("group").alias("name"), "digest"), "group", ["name"])
    upper = levels_above(over)
    none = F.array().cast("array<struct<left:string,right:string>>")
    root = (upper[-1] if upper else over).where("n = 1").select("group", F.lit(0).cast("long").alias("place"), F.col("digest").alias("root"), none.alias("path"))
    parents = _descended(upper, root, ["root"]) if upper else root
    tops = proved(over, parents, [F.col("name").alias("group"), F.col("digest").alias("subroot")], ["root"])
    tops = checkpointed(tops.select("group", F.lit(0).cast("long").alias("place"), "subroot", "root", "path"))
    above = rows.where("n = 1").select("group").join(tops, "group").select("group", "place", "subroot", "root", "path")
    if levels:
        above = _descended(levels, tops, ["subroot", "root"]).unionByName(above)
    return proved(rows, above, [c for c in leaves.columns if c != "group"], ["subroot", "root"])


def proof_digest(path: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    return _digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a proof lead to. A level at which the run has no sibling is hashed all the same."""
    return F.aggregate(path, leaf, lambda d, s: _digest(F.concat(s["left"], d, s["right"])))


def audited(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of all documents. Where tampered is true the root
    is folded from a leaf whose text has A-Z lower-cased, else from the original leaf; siblings are always the originals."""
    lower = F.translate(named("text"), CAPITALS, CAPITALS.lower())
    fields = [named(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaves = docs.select(
        named("lang").alias("group"), named("doc_id").alias("id"),
        leaf_digest(*fields, named("text")).alias("digest"),
        F.when(tampered, leaf_digest(*fields, lower)).alias("other"),
    )
    rows = manifest(checkpointed(leaves)).withColumn("folded_root", folded(F.coalesce("other", "digest"), F.col("path")))
    return rows.select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
