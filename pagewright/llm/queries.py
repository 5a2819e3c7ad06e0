"""The queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The default vocabulary file: that of the installed package of public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm import quality
    from pagewright.llm.common import held_out

    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 4, 2))
    rows = quality.scored(docs, model, ["doc_id"])
    return rows.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.licences import licences

    rows = licences(table(spark, sf_dir, "documents"), ["doc_id"]).withColumn("matches", F.filter("matches", lambda m: m["wins"]))
    best = F.array_max(F.transform("matches", lambda m: F.struct(m["dice"].alias("dice"), (-m["start"]).alias("place"), m["licence"].alias("licence"))))
    names = F.array_join(F.array_sort(F.array_distinct(F.col("matches.licence"))), ",")
    return rows.select("doc_id", F.size("matches").cast("long").alias("n_matches"), names.alias("licences"), best["licence"].alias("best"), F.round(best["dice"], 6).alias("dice"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary())


def op4_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.blocks import main_text

    return main_text(table(spark, sf_dir, "pages"), ["page_id", "url"]).withColumn("n_chars", F.char_length("text").cast("long"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.mixing import draws

    rows = draws(table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"), F.col("size").cast("long").alias("size"), "source_size", "target",
        (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source", "copies",
        F.get("shards", F.lit(0)).alias("shard"), F.get("shards", F.lit(1)).alias("second_shard"),
    )


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.substrings import without_repeats

    return without_repeats(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.neardup import classes

    rows = classes(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.spotsigs import compared

    return compared(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm import language
    from pagewright.llm.common import held_out

    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs, ~held_out(F.col("doc_id"), 5, 0))
    rows = language.identified(docs, model, ["doc_id"])
    return rows.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.common import held_out
    from pagewright.llm.merkle import audited

    return audited(table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 3, 0))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.common import shared_folder
    from pagewright.llm.tokenfiles import read_documents, write_ids

    folder = shared_folder(spark, "token-ids")
    write_ids(table(spark, sf_dir, "documents"), folder, vocabulary())
    return read_documents(spark, folder)


QUERIES = {"op1_quality": op1_quality, "op9_language": op9_language, "op3_packing": op3_packing, "op5_mixing": op5_mixing, "op10_topk": op10_topk, "op7_minhash": op7_minhash, "op6_substrings": op6_substrings, "op8_spotsigs": op8_spotsigs, "op4_blocks": op4_blocks, "op2_licences": op2_licences, "op11_lexical": op11_lexical, "op12_merkle": op12_merkle, "op13_token_files": op13_token_files}

#: crc32 of the decimal document id, bit by bit.
CRC32_SQL = """xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""


def merkle_sql(levels: int = 8, group_levels: int = 4) -> str:
    """SQL of op12: the levels of a tree are written out, enough of them for 8^levels rows a language."""

    def value(column: str) -> str:
        return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(map(value, ('doc_id', 'source', 'lang', 'n_chars', text)))})"

    def tree(name: str, n: int) -> str:
        """name0 (g, p, n, d) is given; name<k> are its levels, name_run<k> the digests of the runs with more than one node above."""
        out = []
        for k in range(n):
            out.append(f"{name}_run{k} AS (SELECT g, p // 8 AS p, (any_value(n) + 7) // 8 AS n, list(d ORDER BY p) AS ds FROM {name}{k} WHERE n > 1 GROUP BY g, p // 8)")
            out.append(f"{name}{k + 1} AS (SELECT g, p, n, sha256(array_to_string(ds, '')) AS d FROM {name}_run{k} UNION ALL SELECT g, p, n, d FROM {name}{k} WHERE n = 1)")
        return ",\n".join(out)

    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    joins, steps = [], []
    for name, place, group, n in (("a", "a0.p", "a0.g", levels), ("b", "b0.p", "''", group_levels)):
        for k in range(n):
            joins.append(f"LEFT JOIN {name}_run{k} ON {name}_run{k}.g = {group} AND {name}_run{k}.p = {place} // {8 ** (k + 1)}")
            at, ds = f"({place} // {8**k} % 8)", f"{name}_run{k}.ds"
            left, right = f"coalesce(array_to_string({ds}[1:{at}], ''), '')", f"coalesce(array_to_string({ds}[{at} + 2:], ''), '')"
            steps.append(f"CASE WHEN {ds} IS NOT NULL THEN {{'l': {left}, 'd': '', 'r': {right}}} END")
    return f"""
WITH leaves AS (
  SELECT doc_id, coalesce('+' || lang, '') AS g, {leaf('text')} AS d,
         CASE WHEN {CRC32_SQL} % 3 = 0 THEN {leaf(f'translate(text, {letters})')} END AS other
  FROM documents
),
a0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM leaves),
{tree("a", levels)},
b0 AS (SELECT '' AS g, g AS name, row_number() OVER (ORDER BY g) - 1 AS p, count(*) OVER () AS n, d FROM a{levels}),
{tree("b", group_levels)},
proofs AS (
  SELECT a0.doc_id, a0.d AS leaf, b0.d AS subroot, (SELECT d FROM b{group_levels}) AS root, coalesce(a0.other, a0.d) AS begin,
         list_filter([{", ".join(steps)}], lambda s: s IS NOT NULL) AS path
  FROM a0 JOIN b0 ON b0.name = a0.g
  {" ".join(joins)}
),
folded AS (
  SELECT *, list_reduce(list_concat([{{'l': '', 'd': begin, 'r': ''}}], path),
                        lambda x, s: {{'l': '', 'd': sha256(s.l || x.d || s.r), 'r': ''}}).d AS folded_root
  FROM proofs
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda s: s.l || s.r), ''), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM folded
"""


#: Terms of a text: runs of letters and digits of ASCII and of all other characters.
TERMS_SQL = r"""unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"""

ORACLE = {
    "op11_lexical": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
items AS (SELECT row_number() OVER () AS i, item_id, min(text) AS text FROM benchmark GROUP BY item_id),
doc_terms AS (SELECT r, term, count(*) AS tf FROM (SELECT r, {TERMS_SQL} AS term FROM docs) GROUP BY r, term),
item_terms AS (SELECT i, term, count(*) AS times FROM (SELECT i, {TERMS_SQL} AS term FROM items) GROUP BY i, term),
sizes AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM doc_terms GROUP BY r),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM doc_terms, totals GROUP BY term
),
scores AS (
  SELECT i, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms)))) AS BIGINT) AS score
  FROM item_terms JOIN doc_terms USING (term) JOIN weights USING (term) JOIN sizes USING (r), totals
  GROUP BY i, r
),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS k, doc_id, score
  FROM scores JOIN docs USING (r) JOIN items USING (i) WHERE score > 0
)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM ranked WHERE k <= 20
""",
    "op12_merkle": merkle_sql(),
    "op10_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
""",
}
