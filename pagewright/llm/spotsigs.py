"""SpotSigs fingerprints in DataFrame functions alone.

A signature is a common word (an anchor) with the chain of the next `CHAIN` content words after it, other anchors left
out, searched in the next `REACH` words. A text's fingerprint is its sorted set of signatures, 32 bits each. The set
follows the prose of a text: navigation and lists, which hold few common words, leave few traces in it.

Likeness is the Jaccard similarity of two sets. The search partitions fingerprints by set length, in steps of the
threshold, since sets whose lengths differ more cannot be similar; within a partition it meets only fingerprints that
share one of a query's rarest signatures, and prunes by length before it counts the intersection.

Defined results: null text is the empty text; a text without an anchor has one signature made of its whole text, so that
equal texts always have equal fingerprints; chains at the end of a text may be shorter; rows repeated exactly follow
one another; a single row is its own next document; rows of one doc_id follow in text order, a null doc_id comes first; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import named

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their "
    "they this to was were which will with you "
    "als auf aus bei das dem den der des die ein eine er es für ich im ist mit nicht sein sich sie so um und von war wie zu "
    "au aux avec ce ces dans de du elle en est et il la le les leur mais ne par pas plus pour qui que se ses sur un une "
    "al como con del el la las lo los más no para pero por se su sus una y"
)
CHAIN = 2
REACH = 8
_MARK = "~"


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def marked(words_: Column) -> Column:
    """Words with anchors marked, so that later steps look at one character."""
    anchors = sorted(set(ANCHORS.split()))
    return F.transform(words_, lambda w: F.when(w.isin(*anchors), F.concat(F.lit(_MARK), w)).otherwise(w))


def signatures(marked_: Column, text: Column) -> Column:
    """Sorted distinct signatures of a column of marked words."""

    def content(w: Column) -> Column:
        return ~w.startswith(_MARK)

    def signature(w: Column, i: Column) -> Column:
        chain = F.slice(F.filter(F.slice(marked_, i + 2, REACH), content), 1, CHAIN)
        return F.when(w.startswith(_MARK), F.shiftrightunsigned(F.xxhash64(w, chain), 32))

    spots = F.array_sort(F.array_distinct(F.array_compact(F.transform(marked_, signature))))
    return F.when(F.size(spots) > 0, spots).otherwise(F.array(F.shiftrightunsigned(F.xxhash64(F.lit("whole"), text), 32)))


def fingerprint(signatures_: Column) -> Column:
    """A set of signatures as text."""
    return F.array_join(F.transform(signatures_, lambda s: F.lower(F.hex(s))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two non-empty sets of signatures."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def with_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """df and a column of the signatures of its column text."""
    step = df.withColumn("__m", marked(words(F.col(text))))
    return step.withColumn(out, signatures(F.col("__m"), F.col(text))).drop("__m")


def with_next(rows: DataFrame) -> DataFrame:
    """rows (id, text) with own, their signatures, and next_text and following, the text and signatures of the row that
    follows by id (after the last: the first). Signatures are made once, before rows are dealt, and travel with them.

    Rows are dealt into buckets of id ranges, several to a shuffle partition; the first rows of each bucket are added to
    the bucket before it as its end, so that no window spans more than a bucket. Bucket bounds come from approximate
    quantiles; one number per bucket reaches the driver.
    """
    spark = rows.sparkSession
    side = max(2, math.isqrt(4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    shares = [(k + 1) / (side * side) for k in range(side * side - 1)]
    cuts = rows.select(F.percentile_approx("id", shares, 50 * side * side).alias("c")).first().c or []
    cuts = sorted(set(cuts))
    groups = [cuts[k : k + side] for k in range(0, len(cuts), side)] or [[]]
    tops = [g[0] for g in groups if g]

    def below(array: Column) -> Column:
        return F.size(F.filter(array, lambda c: c <= F.col("id")))

    if tops:
        # Two levels: first among the groups' lowest cuts, then among one group's cuts.
        lits = F.array(*[F.array(*map(F.lit, g)) for g in groups])
        group = F.greatest(below(F.array(*map(F.lit, tops))), F.lit(1))
        bucket = F.when(F.col("id").isNull(), 0).otherwise((group - 1) * side + below(F.element_at(lits, group)))
    else:
        bucket = F.lit(0)
    dealt = rows.withColumn("bucket", bucket.cast("int"))
    lowest = sorted((r.bucket, r.lo) for r in dealt.groupBy("bucket").agg(F.when(F.count("*") == F.count("id"), F.min("id")).alias("lo")).collect())
    ends = [(lo, lowest[k - 1][0]) for k, (_, lo) in enumerate(lowest)]  # the first bucket's rows end the last one
    last = spark.createDataFrame(ends, "lo long, end_of int")
    first_rows = rows.join(F.broadcast(last), rows.id.eqNullSafe(last.lo)).select("id", "text", F.col("end_of").alias("bucket"))
    both = dealt.withColumn("added", F.lit(0)).unionByName(first_rows.withColumn("added", F.lit(1)))
    both = with_signatures(both, "text", "own")
    order = Window.partitionBy("bucket").orderBy("added", F.asc_nulls_first("id"), "text")
    both = both.withColumn("next_text", F.lead("text").over(order)).withColumn("following", F.lead("own").over(order))
    return both.where("added = 0").select("id", "text", "own", "next_text", "following")


def edited(rows: DataFrame) -> DataFrame:
    """rows (id, text, next_text) with n_chars and edited: the last half of the text replaced by the next text's start."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    return rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the signatures of every text: the operator's plain form."""
    rows = docs.select(named(id_col).alias("id"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    return with_signatures(rows, "text", "signatures").select("id", "signatures")


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited texts, with the likeness to the edited and to the next text."""
    rows = docs.select(named(id_col).cast("long").alias("id"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    rows = with_signatures(edited(with_next(rows)), "edited", "changed")
    return rows.select(
        "id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )


def search(queries: DataFrame, corpus: DataFrame, threshold: float = 0.75) -> DataFrame:
    """query_id, id, likeness of the fingerprints (id, signatures) in corpus that are at least threshold like a query's.

    Partition of a set of length n: floor(log n / log(1/threshold)); similar sets lie in equal or adjacent partitions.
    Of a query's n signatures, the n - ceil(threshold n) + 1 rarest in the corpus must hold one that both have.
    """
    step = math.log(1 / threshold)

    def part(n: Column) -> Column:
        return F.floor(F.log(n) / step + 1e-9).cast("int")

    posted = corpus.select(F.col("id"), F.size("signatures").alias("n"), F.explode("signatures").alias("s"))
    often = posted.groupBy("s").agg(F.count("*").alias("often"))
    wanted = queries.select(F.col("id").alias("query_id"), F.size("signatures").alias("m"), F.explode("signatures").alias("s"))
    wanted = wanted.join(often, "s", "left").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("often", F.lit(0)), "s")))
    wanted = wanted.where(F.col("rank") <= F.col("m") - F.ceil(F.col("m") * threshold - 1e-9) + 1).where("often is not null")
    wanted = wanted.withColumn("part", F.explode(F.array(part(F.col("m")) - 1, part(F.col("m")), part(F.col("m")) + 1)))
    met = wanted.join(posted.withColumn("part", part(F.col("n"))), ["part", "s"])
    met = met.where((F.least("n", "m") >= threshold * F.greatest("n", "m") - 1e-9)).select("query_id", "id").distinct()
    met = met.join(corpus.select("id", F.col("signatures").alias("b")), "id").join(queries.select(F.col("id").alias("query_id"), F.col("signatures").alias("a")), "query_id")
    return met.withColumn("likeness", likeness(F.col("a"), F.col("b"))).where(F.col("likeness") >= threshold).select("query_id", "id", "likeness")
