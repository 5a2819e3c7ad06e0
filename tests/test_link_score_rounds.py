"""A round of the link score reads written ranks, however many rounds there are."""

from __future__ import annotations

from pagewright.operators import graph as G


def test_every_round_reads_what_the_last_one_wrote(spark, monkeypatch):
    plans, cut = [], G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    edges = spark.createDataFrame([(0, 1, 1, False), (1, 2, 2, False), (2, 0, 3, False), (2, 3, 4, False)], "from_id long, to_id long, edge_seq long, nofollow boolean")
    G.link_score(spark.range(5).withColumnRenamed("id", "page_id"), edges, rounds=4)
    assert len(plans) == 6 and all(p.count("Join") == 3 for p in plans[2:])
