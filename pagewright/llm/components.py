"""Connected components of an edge table, by contraction; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import checkpointed


def _flat(parents: DataFrame) -> DataFrame:
    """Pointer jumping: id, parent with every parent a root. A row whose parent has no row of its own is at its root."""
    while True:
        up = parents.select(F.col("id").alias("parent"), F.col("parent").alias("grand"))
        jumped = checkpointed(parents.join(up, "parent", "left").select("id", F.coalesce("grand", "parent").alias("parent"), (F.coalesce("grand", "parent") != F.col("parent")).alias("moved")))
        if jumped.where("moved").isEmpty():
            return jumped.select("id", "parent")
        parents = jumped.select("id", "parent")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component for every id in an edge; component is the smallest id of the connected part.

    Each round points every node to its smallest neighbour (partial minima are taken before the shuffle), flattens the
    trees and contracts them to their roots. Null ends and self links are ignored.
    """
    now = checkpointed(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    labels = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = checkpointed(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("parent")))
        roots = _flat(parents)
        if labels is None:
            labels = roots.select("id", F.col("parent").alias("component"))
        else:
            labels = labels.join(roots.withColumnRenamed("id", "component"), "component", "left")
            labels = checkpointed(labels.select("id", F.coalesce("parent", "component").alias("component")))
        left = roots.select(F.col("id").alias("a"), F.col("parent").alias("pa"))
        right = roots.select(F.col("id").alias("b"), F.col("parent").alias("pb"))
        now = checkpointed(now.join(left, "a").join(right, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        if now.isEmpty():
            return labels
