"""Ranked lexical search against plain loops, on odd tables and against its SQL."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, item string, score string, `rank` string, `a.b` string"


def docs_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], DOCS)


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    bags = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    texts = {}
    for i, t in items:
        texts.setdefault(i, []).append(t)
    out = []
    for i, ts in texts.items():
        text = min((t for t in ts if t is not None), default=None)
        found = []
        for d, b in bags:
            m = 75 + 25 * sum(b.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t in terms(text) if b[t])
            found += [(-s, d is not None, d or 0, d)] if s > 0 else []
        out += [(i, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return out


def made(n=300, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünder", "ÜNDER", "東京", "x1y2", "don't", "A_b", "MIXED", "mixed"]
    return [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 60)))) for i in range(n)]


ODD = [(None, "w1 w2 w3 alpha"), (None, None), (1, ""), (1, "w1 w2 W3"), (1, "w1 w2 w3"), (1, "w1 w2 w3"), (9000, " \t\x00--__"), (9001, "w5 " * 50_000), (9002, "naïve w7 w8 w9 w10")]
ITEMS = [(0, "w1 w2 w3 w3"), (1, "none of these 東京 Ünder"), (2, None), (3, ""), (None, "w7 mixed MIXED"), (4, "w8 w9"), (4, "w1"), (5, "w5"), (6, "absent only"), (5, "w5")]


def key(r):
    return (r[0] is not None, r[0] or 0, *r[1:2], r[2] is not None, r[2] or 0, r[3])


def ranked(rows):
    return sorted(map(tuple, rows), key=key)


@pytest.mark.parametrize("most_postings", [500_000, 4])
def test_against_loops(spark, most_postings):
    from pagewright.llm.lexical import search

    docs = made() + ODD
    items = spark.createDataFrame([(*r, "z") for r in ITEMS], "item_id long, text string, doc string")
    got = search(docs_frame(spark, docs).repartition(7), items, most_postings=most_postings)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked(got.collect()) == ranked(brute(docs, ITEMS))


def test_many_equal_scores(spark):
    """A third of all rows are one text: ties go to the smaller ids, wherever they stand."""
    from pagewright.llm.lexical import search

    docs = [(i, "same words here" if i % 3 else f"other {i}") for i in range(3000)]
    random.Random(1).shuffle(docs)
    items = spark.createDataFrame([(7, "words")], "item_id long, text string")
    got = search(docs_frame(spark, docs).repartition(6), items).collect()
    assert ranked(got) == ranked(brute(docs, [(7, "words")]))
    assert [r.doc_id for r in sorted(got, key=lambda r: r.rank)] == [i for i in range(30) if i % 3][:20]


def test_no_documents_or_items(spark):
    from pagewright.llm.lexical import search

    items = spark.createDataFrame([(7, "words")], "item_id long, text string")
    assert search(docs_frame(spark, made(5)).limit(0), items).collect() == []
    assert search(docs_frame(spark, made(5)), items.limit(0)).collect() == []
    assert search(docs_frame(spark, [(1, None), (2, "?")]), items).collect() == []


def test_sums_beyond_doubles():
    from pagewright.llm.lexical import Index

    big = Index(np.array([0, 1, 2]), np.array([0, 0]), np.array([2**20 + 1, 3]), np.array([9000, 8999]), 1, 10, 100)
    m = 75 + 25 * 4 * 10 // 100
    want = (2**20 + 1) * 9000 * (2 * 10**9 // (2000 + 12 * m)) + 3 * 8999 * (3 * 10**9 // (3000 + 12 * m))
    assert big.most * 2 > 2**53 and big.scores([4], np.array([0, 1]), np.array([2, 3]), np.array([0, 0])).tolist() == [[want]]


def test_heaps_keep_what_a_sort_keeps():
    from pagewright.llm.lexical import Heaps

    rng = np.random.default_rng(4)
    heaps, seen = Heaps(3, 4), defaultdict(list)
    for _ in range(30):
        doc, name, scores = rng.integers(0, 40, 9), rng.random(9) < 0.9, rng.integers(0, 6, (9, 3))
        heaps.offer(np.where(name, doc, 0), name, scores)
        for d in range(9):
            for i in range(3):
                if scores[d, i] > 0:
                    seen[i].append((-scores[d, i], bool(name[d]), int(doc[d]) if name[d] else 0))
    item, doc, name, score = heaps.rows()
    for i in range(3):
        got = [(-int(s), bool(z), int(d)) for s, z, d in zip(score[item == i], name[item == i], doc[item == i])]
        assert got == sorted(seen[i])[:4]


def test_query_gives_the_rows_of_its_sql(spark):
    import __spark_entry__ as entry

    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = entry.queries()["op11_lexical"](spark, sf_dir)
    answer = con.execute(entry.oracle_sql()["op11_lexical"])
    assert [d[0] for d in answer.description] == df.columns
    rows = answer.fetchall()
    assert len(rows) == 800 and ranked(df.collect()) == ranked(rows)
