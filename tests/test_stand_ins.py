"""Stand-ins for broken pages, against a comparison of all pairs."""

from __future__ import annotations

import random

import pytest

from pagewright.operators import graph as G


@pytest.mark.parametrize(("vocabulary", "longest", "most"), [(6, 3, 6), (12, 9, 3), (40, 5, 0), (9, 9, 6)])
def test_best_shared_against_all_pairs(spark, vocabulary, longest, most):
    rng = random.Random(vocabulary)
    rows = [(i, rng.choice(["h", "H", None]), rng.choice("ab"), [*rng.sample([f"w{k}" for k in range(vocabulary)], rng.randrange(longest)), "all"], rng.random() < 0.4) for i in rng.sample(range(900), 400)]
    df = spark.createDataFrame(rows, "page_id long, host string, folder string, words array<string>, broken boolean")
    got = sorted((r.page_id, r.stand_in) for r in G.best_shared(df.where("broken"), df.where("NOT broken"), ["host", "folder"], most).collect())
    wanted = []
    for i, h, f, w, broken in rows:
        met = [(-len(set(w) & set(w2)), j) for j, h2, f2, w2, b2 in rows if not b2 and h is not None and (h, f) == (h2, f2)]
        if broken and met:
            wanted.append((i, min(met)[1]))
    assert got == sorted(wanted)


def test_pages_of_a_folder_are_not_paired(spark):
    """A hundred thousand pages of one folder on either side: ten thousand million pairs."""
    df = spark.range(200_000).selectExpr("id AS page_id", "'h' AS host", "'f' AS folder", "array('f', concat('n', id div 4), concat('k', id % 7)) AS words")
    got = G.best_shared(df.where("page_id % 2 = 1"), df.where("page_id % 2 = 0"), ["host", "folder"])
    r = {x.page_id: x.stand_in for x in got.where("page_id < 40").collect()}
    wanted = {i: min(range(0, 200, 2), key=lambda j: (-(i // 4 == j // 4) - (i % 7 == j % 7), j)) for i in range(1, 40, 2)}
    assert got.count() == 100_000 and r == wanted
    none = df.limit(0)
    assert G.best_shared(none, df, ["host", "folder"]).count() == 0 == G.best_shared(df, none, ["host", "folder"]).count()
