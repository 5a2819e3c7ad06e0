"""The Merkle manifest against plain loops, on odd tables and against its SQL."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, place string, n string, `group` string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, tampered=False):
    doc_id, text, lang, source, n_chars = row
    text = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text) if tampered and text is not None else text
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return digest("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def climb(nodes):
    """Root of a list of digests, and each one's proof as (left, right) a level."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for proof, i in zip(proofs, at):
            run = i - i % 8
            proof.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 8])))
        nodes, at = [digest("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)], [i // 8 for i in at]
    return nodes[0], proofs


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    ready, subroots = {}, []
    for g in names:
        ready[g] = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        subroots.append(climb([leaf_of(r) for r in ready[g]]))
    root, upper = climb([s for s, _ in subroots])
    out = []
    for g, (subroot, proofs), above in zip(names, subroots, upper):
        for r, proof in zip(ready[g], proofs):
            path = proof + above
            d = leaf_of(r, zlib.crc32(str(r[0]).encode() if r[0] is not None else b"") % 3 == 0)
            for left, right in path:
                d = digest(left + d + right)
            out.append((r[0], leaf_of(r), subroot, root, digest("".join(a + b for a, b in path)), d, d == root))
    return out


def made(n, langs, seed=3):
    rng = random.Random(seed)
    return [(i * 3 % 1009, f"Text {rng.randrange(10**6)} Étude" if i % 7 else None, rng.choice(langs), None if i % 11 == 0 else f"s{i % 3}", i if i % 5 else None) for i in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        made(1, ["en"]),
        made(8, ["en"]),
        made(9, ["en"]),
        made(65, ["en", None]),
        made(640, ["en"] * 8 + ["de", None, ""]),  # one hot group
        [*made(120, [f"l{i:02}" for i in range(20)]), (5, "only", "zz", "s", 1)],  # more groups than a run has
        [(None, "A", "en", "s", 1)] * 20 + [(4, "B", "en", "s", 1)] * 9 + [(4, "b", "en", "s", 1), (4, "", "en", "s", 1), (None, None, None, None, None)],
        [(1, "X" * 300_000, "en", "s", 300_000), (2, "ÀÉ東京 ABC", "Zé", "s:1", -3), (0, "-", "a", "-", 0)],
    ],
)
def test_against_loops(spark, rows):
    from pagewright.llm.common import held_out
    from pagewright.llm.merkle import audited

    got = audited(frame(spark, rows).repartition(3), held_out(F.col("doc_id"), 3, 0)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:]))
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_no_rows(spark):
    from pagewright.llm.merkle import audited

    assert audited(frame(spark, made(3, ["en"])).limit(0), F.lit(True)).collect() == []


def test_tampering_is_found_where_it_changes_a_text(spark):
    from pagewright.llm.merkle import audited

    rows = [(i, "Upper" if i % 2 else "lower", "en", "s", 5) for i in range(50)]
    assert {(r.doc_id % 2, r.verified) for r in audited(frame(spark, rows), F.lit(True)).collect()} == {(1, False), (0, True)}
    assert all(r.verified for r in audited(frame(spark, rows), F.lit(False)).collect())


def test_query_gives_the_rows_of_its_sql(spark):
    import __spark_entry__ as entry

    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    df = entry.queries()["op12_merkle"](spark, sf_dir)
    answer = con.execute(entry.oracle_sql()["op12_merkle"])
    assert [d[0] for d in answer.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(answer.fetchall())
