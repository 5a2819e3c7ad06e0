"""The order of a crawl against a plain queue, on hand-made and random sites."""

from __future__ import annotations

import random

import pytest

from pagewright.operators.crawl import crawl_order

PAGES = "page_id long, follow boolean, redirect_to long, in_sitemap boolean"
EDGES = "from_id long, to_id long, edge_seq long, nofollow boolean"


def brute(pages, edges, root, budget, passes=4):
    known = {p: (follow, to, in_map) for p, follow, to, in_map in pages if p is not None}
    if budget < 1 or root not in known:
        return set()
    out, level, admitted, depth = {root: (0, None, "start")}, [root], 1, 0
    while level:
        heads = {p: [p] for p in level}  # a page and the targets that came with it
        going = [(p, p) for p in level]
        for _ in range(passes):
            hops = []
            for head, p in going:
                to = known[p][1]
                if to in known and to not in out:
                    out[to] = (depth, out[p][1], "redirect")
                    heads[head].append(to)
                    hops.append((head, to))
            going = hops
        depth, nxt = depth + 1, []
        for head in level:
            for p in heads[head]:
                if not known[p][0] or known[p][1] is not None:
                    continue
                for _, to, _, nofollow in sorted((e for e in edges if e[0] == p), key=lambda e: e[2]):
                    if not nofollow and to in known and to not in out and admitted < budget:
                        out[to] = (depth, p, "link")
                        admitted += 1
                        nxt.append(to)
        level = nxt
    for p in sorted(known):
        if known[p][2] and p not in out and admitted < budget:
            out[p] = (None, None, "sitemap")
            admitted += 1
    return {(p, *v) for p, v in out.items()}


def crawl(spark, pages, edges, root, budget):
    rows = crawl_order(spark.createDataFrame(pages, PAGES), spark.createDataFrame(edges, EDGES).repartition(3), root, budget).collect()
    assert len({r.page_id for r in rows}) == len(rows)
    return set(map(tuple, rows))


def test_a_site_by_hand(spark):
    #     0 -> 1, 2, 3;  2 redirects to 4, 4 to 5;  5 -> 6;  1 says nofollow, so 7 is not found;  3 -> 5 (taken), 8 by nofollow
    pages = [(i, i != 1, {2: 4, 4: 5}.get(i), i >= 7) for i in range(10)] + [(None, True, None, True)]
    edges = [(0, 2, 2, False), (0, 1, 1, False), (0, 3, 3, False), (5, 6, 4, False), (1, 7, 5, False), (3, 5, 6, False), (3, 8, 7, True), (6, 99, 8, False), (2, 9, 9, False)]
    want = {(0, 0, None, "start"), (1, 1, 0, "link"), (2, 1, 0, "link"), (3, 1, 0, "link"), (4, 1, 0, "redirect"), (5, 1, 0, "redirect"), (6, 2, 5, "link")}
    sitemap = {(p, None, None, "sitemap") for p in (7, 8, 9)}
    assert crawl(spark, pages, edges, 0, 100) == want | sitemap == brute(pages, edges, 0, 100)
    assert crawl(spark, pages, edges, 0, 6) == want | {(7, None, None, "sitemap")}
    assert crawl(spark, pages, edges, 0, 3) == {(0, 0, None, "start"), (1, 1, 0, "link"), (2, 1, 0, "link"), (4, 1, 0, "redirect"), (5, 1, 0, "redirect")}
    assert crawl(spark, pages, edges, 0, 0) == crawl(spark, pages, edges, 50, 9) == set()


@pytest.mark.parametrize("seed", range(4))
def test_random_sites(spark, seed):
    rng = random.Random(seed)
    n = 60
    pages = [(i, rng.random() < 0.9, rng.randrange(n) if i and rng.random() < 0.25 else None, rng.random() < 0.5) for i in range(n)]
    edges = [(rng.randrange(n), rng.randrange(n + 3), k, rng.random() < 0.1) for k in range(110)]
    budget = rng.choice([7, 25, 200])
    assert crawl(spark, pages, edges, 0, budget) == brute(pages, edges, 0, budget)
