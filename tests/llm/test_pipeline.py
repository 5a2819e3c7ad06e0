"""The pipeline on the smallest tables: what each stage must keep and must take."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from tests.llm.test_operators import brute_components, brute_substrings


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    frames = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != "window_packing":
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        frames.append(docs.collect())
    good, single, cut, mixed, packed = frames
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in good}
    assert sum(q == 1 and i in kept for i, q in labels.items()) >= 0.97 * sum(q == 1 for q in labels.values())
    component = brute_components([(r.doc_id, r.text) for r in good])
    assert {r.doc_id for r in single} == {i for i, (_, c) in component.items() if i == c}
    want = brute_substrings([(r.doc_id, r.text) for r in single])
    assert {r.doc_id for r in cut} == {r.doc_id for r in single}
    assert all(len(r.text.encode().split()) == want[r.doc_id][0] - want[r.doc_id][1] for r in cut)
    times = Counter(r.doc_id for r in mixed)
    assert set(times) <= {r.doc_id for r in cut} and max(times.values()) <= 2
    assert {r.doc_id for r in packed} == set(times)


def test_run_is_registered(spark, sf_dir):
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries()
    assert entry.queries()["pipeline"](spark, sf_dir).columns[:3] == ["doc_id", "start", "length"]
