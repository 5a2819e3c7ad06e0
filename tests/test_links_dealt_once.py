"""Rounds over links move pages, not links, and give the same as links joined one by one."""

from __future__ import annotations

import re

from pagewright.operators import graph as G

LINKS = [(0, 1, 1, False), (0, 1, 2, False), (1, 1, 3, False), (1, 2, 4, False), (2, 3, 5, True), (2, 9, 6, False), (9, 3, 7, False), (2, 0, 8, False), (0, 3, 9, False), (None, 1, 10, False), (1, None, 11, False), (2, None, 12, False)]
SCHEMA = "from_id long, to_id long, edge_seq long, nofollow boolean"


def test_rounds_move_no_links(spark, monkeypatch):
    plans, cut = [], G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = spark.createDataFrame(LINKS, SCHEMA)
        score = G.link_score(spark.range(5).withColumnRenamed("id", "page_id"), edges, rounds=3)
        assert sorted(r.page_id for r in score.collect()) == [0, 1, 2, 3, 4]
        rounds, plans[:] = plans[2:], []
        assert {(r.page_id, r.depth) for r in G.click_depth(edges, 0).collect()} == {(0, 0), (1, 1), (3, 1), (2, 2), (None, 2), (9, 3)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    moved = [len(re.findall(r"Exchange hashpartitioning\(from_id#\d+L, \d+\), ENSURE_REQUIREMENTS", p)) for p in (*rounds, *plans)]
    # The ranks of a round go to the links; a level goes there by its own page_id.
    assert moved[:3] == [1, 1, 1] and not any(moved[3:])


def test_targets_of_each_page(spark):
    edges = spark.createDataFrame(LINKS, SCHEMA)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    for pages, want in ((spark.range(5).withColumnRenamed("id", "page_id"), {0: [1, 3], 1: [2], 2: [0], 3: [], 4: []}), (None, {0: [1, 3], 1: [2, None], 2: [0, 9, None], 9: [3]})):
        links = G.targets(edges, pages)
        assert {r.from_id: sorted(r.to_ids, key=str) for r in links.collect()} == want and len(want) == links.count()
        links.unpersist()
    G.click_depth(edges, 0)
    G.link_score(spark.range(5).withColumnRenamed("id", "page_id"), edges, rounds=1)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before
