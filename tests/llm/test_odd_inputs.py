"""Every operator and stage on odd tables: nulls, empty and very long texts, repeated rows, no rows, clashing columns."""

from __future__ import annotations

import pytest

CLASHES = ["__key", "__score", "__text", "__shard", "__rows", "__id", "a.b", "box", "id", "row", "key", "spans", "copy", "shard", "score", "label", "component", "with `ticks`"]
LONG = " ".join(f"word{i % 977}" for i in range(125_000))  # about a megabyte
LONG_LINE = "x" * 1_000_000


def odd_docs(spark):
    rows = [(1, "A plain sentence of some words, and another one. It ends here."), (2, None), (3, ""), (4, LONG), (5, LONG_LINE), (6, " \t\n"), (7, "!!!")]
    rows += [(1, rows[0][1]), (4, LONG), (None, "no id here"), (8, LONG + " end"), (9, rows[0][1])]
    rows = [(i, t, "en" if i != 3 else None, "s1" if i != 5 else None, len(t or ""), *(f"{c}-{k}" for c in CLASHES)) for k, (i, t) in enumerate(rows)]
    extra = ", ".join("`" + c.replace("`", "``") + "` string" for c in CLASHES)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars int, {extra}")


def labels(spark):
    return spark.createDataFrame([(1, 1), (7, 0), (3, None), (None, 1), (1, 1), (5, 0)], "doc_id long, quality int")


def stages(spark):
    from pagewright.llm import mixing, neardup, quality, substrings

    return {
        "quality": lambda d: quality.accepted(d, quality.learn(d, labels(spark))),
        "neardup": neardup.deduplicated,
        "substrings": substrings.cleaned,
        "mixing": lambda d: mixing.mix(d),
    }


@pytest.mark.parametrize("name", ["quality", "neardup", "substrings", "mixing"])
def test_stages_keep_clashing_columns(spark, name):
    docs = odd_docs(spark)
    stage = stages(spark)[name]
    got = stage(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    before = {(r.doc_id, r["__key"]): r for r in docs.collect()}
    for r in rows:
        old = before[(r.doc_id, r["__key"])]
        assert all(r[c] == old[c] for c in CLASHES)
    if name == "substrings":  # the second copy of the long text goes, its own words after it stay
        assert {(r.doc_id, r.text) for r in rows if r.doc_id == 8} == {(8, "end")}
        assert len(rows) == len(before)
    if name == "neardup":
        assert sorted((r.doc_id or 0) for r in rows) == [0, 1, 1, 2, 3, 4, 4, 5, 6, 7]
    assert stage(docs.limit(0)).collect() == []


def test_operators_on_clashing_columns(spark):
    from pagewright.llm import blocks, language, licences, mixing, packing, quality, spotsigs, substrings, topk
    from pagewright.llm.queries import vocabulary
    from pyspark.sql import functions as F

    docs = odd_docs(spark)
    n = docs.count()
    model = language.learn(docs)
    keep = ["doc_id", "a.b", "__text", "box"]
    assert quality.scored(docs, quality.learn(docs, labels(spark)), keep, score_col="s").columns == [*keep, "s"]
    scores = quality.scored(docs, quality.learn(docs, labels(spark)), keep, score_col="s").collect()
    assert len(scores) == n and all(0 <= r.s <= 1 for r in scores)
    found = licences.licences(docs, keep).collect()
    assert len(found) == n and all(not r.matches for r in found)
    said = {(r.doc_id, r.lang_pred) for r in language.identified(docs, model, keep).collect()}
    assert said == {(i, "en") for i in (1, 4, 5, 8, 9, None)} | {(i, "und") for i in (2, 3, 6, 7)}
    assert blocks.main_text(docs.withColumnRenamed("text", "html"), ["doc_id", "a.b"]).count() == n
    drawn = mixing.draws(docs).collect()
    assert len(drawn) == n and all(r.copies == len(r.shards) for r in drawn)
    pieces = packing.pack(docs, vocabulary()).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert all(r.n == r.t * (2 if r.doc_id in (1, 4) else 1) for r in pieces) and len(pieces) == 10
    gone = {r.id: r.n_removed for r in substrings.without_repeats(docs).collect()}
    assert gone[8] == 125_000 and gone[4] == gone[1] == gone[None] == 0
    prints = spotsigs.compared(docs.where("doc_id is not null and doc_id not in (4, 8)")).collect()
    assert len({r.fingerprint for r in prints if r.id in (1, 9)}) == 1
    vectors = spark.createDataFrame([(i, [float(i)] * 4, "x") for i in range(5)], "vec_id long, embedding array<float>, `a.b` string")
    assert topk.top_k(vectors, F.col("vec_id") == 0).count() == 4
    empty = docs.limit(0)
    assert licences.licences(empty, keep).count() == language.identified(empty, None, keep).count() == mixing.draws(empty).count() == 0
    assert language.learn(empty) is None and spotsigs.compared(empty).count() == 0
    assert blocks.main_text(empty.withColumnRenamed("text", "html"), ["doc_id"]).count() == 0


def test_pipeline_on_odd_tables(spark, tmp_path):
    """The whole pipeline on nulls, repeats, long texts and extra columns, and on empty tables."""
    import corpus_pipeline

    for folder, docs, marks in (("odd", odd_docs(spark), labels(spark)), ("none", odd_docs(spark).limit(0), labels(spark).limit(0))):
        docs.write.parquet(f"{tmp_path}/{folder}/documents.parquet")
        marks.write.parquet(f"{tmp_path}/{folder}/labels.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{folder}").collect()
        assert (len(rows) > 0) == (folder == "odd")
        assert all(r.length > 0 for r in rows)
