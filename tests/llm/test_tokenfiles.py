"""Directly addressable codes and the files of token ids."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

DOCS = "doc_id long, text string, id string, k string, `a.b` string"
ODD = [(3, "three words here"), (1, None), (1, "again one"), (None, "no id"), (7, ""), (7, ""), (2, "x" * 50_000), (9, "naïve 東京 text<|endoftext|> end"), (-4, "below zero\n\t."), (None, "no id")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**32 - 1)), max_size=1500), st.data())
def test_codes_give_any_number_back(values, data):
    from pagewright.llm.tokenfiles import Codes, encoded

    values = np.array(values, np.uint32)
    written = encoded(values)
    codes = Codes(written)
    assert len(codes) == len(values) and codes.size == len(written)
    assert codes.run(0, len(values)).tolist() == values.tolist()
    if len(values):
        places = data.draw(st.lists(st.integers(0, len(values) - 1), max_size=40))
        assert codes.at(places).tolist() == values[places].tolist()
        a, z = sorted(data.draw(st.tuples(st.integers(0, len(values)), st.integers(0, len(values)))))
        assert codes.run(a, z).tolist() == values[a:z].tolist()
    with pytest.raises(IndexError):
        codes.at([len(values)])


def test_widths_are_the_best():
    from pagewright.llm.tokenfiles import fitted_widths

    values = np.random.default_rng(2).zipf(1.4, 3000).clip(max=2**9 - 1).astype(np.uint32)
    lengths = np.array([max(1, int(v).bit_length()) for v in values])

    def cost(widths):
        begins = np.r_[0, np.cumsum(widths)]
        return sum(int((lengths > a).sum() if k else len(lengths)) * (w + (k < len(widths) - 1)) for k, (a, w) in enumerate(zip(begins, widths)))

    assert lengths.max() == 9
    ends = [[k + 1 for k in range(8) if mask >> k & 1] + [9] for mask in range(256)]  # every way to cut nine bits
    cuts = [np.diff([0, *e]).tolist() for e in ends]
    for most in (1, 2, 3, 9):
        assert cost(fitted_widths(values, most)) == min(cost(c) for c in cuts if len(c) <= most)


def brute(rows, vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    return [(d, [*t.encode(x or "", add_special_tokens=False).ids, 0]) for d, x in rows]


@pytest.mark.parametrize("segment_tokens", [1, 50, 1 << 18])
def test_files_round_trip(spark, tmp_path, segment_tokens):
    from pagewright.llm.queries import vocabulary
    from pagewright.llm.tokenfiles import read_documents, read_index, read_segments, tokens_at, write_ids

    rows = ODD + [(100 + i, f"row {i} " * (i % 17)) for i in range(120)]
    folder = f"{tmp_path}/ids{segment_tokens}"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges would become one file
    write_ids(frame(spark, rows).repartition(5), folder, vocabulary(), segment_tokens=segment_tokens)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in read_documents(spark, folder).collect())
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((d is not None, d or 0, n, c) for _, d, n, c in got) == sorted((d is not None, d or 0, len(x), crc(x)) for d, x in brute(rows, vocabulary()))
    assert [s for s, *_ in got] == [0, *np.cumsum([n for _, _, n, _ in got]).tolist()[:-1]]
    order = [(d is not None, d or 0) for _, d, _, _ in got]
    assert order == sorted(order)
    # Any position by itself, asked for twice, beyond the end and below zero.
    by_doc = {}
    for d, x in brute(rows, vocabulary()):
        by_doc.setdefault((d, len(x), crc(x)), x)
    flat = [t for _, d, n, c in got for t in by_doc[d, n, c]]
    asked = [0, 1, 1, len(flat) - 1, len(flat), -1, *range(3, len(flat), 211)]
    found = tokens_at(spark, folder, spark.createDataFrame([(p,) for p in asked], "position long")).collect()
    assert sorted(map(tuple, found)) == sorted((p, flat[p]) for p in {p for p in asked if 0 <= p < len(flat)})
    assert read_index(spark, folder).count() > 1
    short = read_segments(spark, folder).where(f"n_tokens < {segment_tokens}").groupBy("file").count()
    assert short.where("count > 1").count() == 0


def test_no_documents(spark, tmp_path):
    from pagewright.llm.queries import vocabulary
    from pagewright.llm.tokenfiles import read_documents, tokens_at, write_ids

    write_ids(frame(spark, ODD).limit(0), f"{tmp_path}/none", vocabulary())
    assert read_documents(spark, f"{tmp_path}/none").collect() == []
    assert tokens_at(spark, f"{tmp_path}/none", spark.createDataFrame([(0,)], "position long")).collect() == []


def test_query_on_whole_table(spark):
    import __spark_entry__ as entry

    from pagewright.llm.queries import vocabulary

    sf_dir = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    start, want = 0, []
    for d, ids in brute(docs, vocabulary()):
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, entry.queries()["op13_token_files"](spark, sf_dir).collect())) == want
