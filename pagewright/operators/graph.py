"""Link graphs: click depth, crawl tree, link score, redirects."""

from __future__ import annotations

from itertools import count

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.session import cut_lineage

#: Links of a part of targets(), about.
PART_LINKS = 1 << 24


def distinct_links(edges: DataFrame) -> DataFrame:
    """from_id, to_id, anchor, nofollow: one row per pair; the first anchor stands (of two at one place the lesser), nofollow
    only if all links say so."""
    return edges.groupBy("from_id", "to_id").agg(F.min_by("anchor", F.struct("edge_seq", "anchor")).alias("anchor"), F.bool_and("nofollow").alias("nofollow"), F.min("edge_seq").alias("edge_seq"))


def targets(edges: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """from_id, to_ids: the distinct other pages that followed links of a page lead to. With pages given, a row for each of them,
    and links between them only; else a row for each page with links.

    The links are dealt by from_id and sorted once, and persisted, which unlike Parquet keeps how they lie: a round that joins them
    moves the other side only. Parts are few, a core's each or so many links, as each sums what a round gives to a page before
    that moves. The caller unpersists.
    """
    links = edges.where("NOT nofollow AND from_id IS NOT NULL AND NOT (from_id <=> to_id)").select("from_id", "to_id")
    if pages is not None:
        links = links.join(pages.select(F.col("page_id").alias("to_id")), "to_id", "left_semi").select("from_id", "to_id")
        # A page's own row has no target.
        links = links.unionByName(pages.select(F.col("page_id").alias("from_id"), F.lit(None).cast("long").alias("to_id")))
    links = cut_lineage(links)
    parts = max(edges.sparkSession.sparkContext.defaultParallelism, -(-links.count() // PART_LINKS))
    out = links.repartition(parts, "from_id").groupBy("from_id").agg(F.array_distinct(F.collect_list("to_id")).alias("to_ids"), F.bool_or(F.col("to_id").isNull()).alias("none"))
    if pages is not None:
        out = out.where("none")
    else:
        out = out.withColumn("to_ids", F.when(F.col("none"), F.array_append("to_ids", F.lit(None).cast("long"))).otherwise(F.col("to_ids")))
    out = out.select("from_id", "to_ids").sortWithinPartitions("from_id").persist(StorageLevel.DISK_ONLY)
    out.count()  # how rows lie is known to plans once they are made
    return out


def click_depth(edges: DataFrame, root: int) -> DataFrame:
    """page_id, depth by levels from root along followed links."""
    links = targets(edges)
    depths = levels(links, root)
    links.unpersist()
    return depths


def levels(links: DataFrame, root: int) -> DataFrame:
    """click_depth of targets(); a round is a join of the last level with the links, until a level is empty."""
    seen = level = links.sparkSession.createDataFrame([(root, 0)], "page_id long, depth int")
    for d in count(1):
        reached = links.join(level, links.from_id == level.page_id).select(F.explode("to_ids").alias("page_id")).distinct()
        level = cut_lineage(reached.join(seen.select(F.col("page_id").alias("at")), F.expr("page_id <=> at"), "left_anti").withColumn("depth", F.lit(d)))
        if level.isEmpty():
            return seen
        # Levels are read where they were written; now and then they become one table, so that plans stay short.
        seen = seen.unionByName(level)
        if d % 16 == 0:
            seen = cut_lineage(seen)


def tree_parents(depths: DataFrame, edges: DataFrame) -> DataFrame:
    """page_id, parent_id: the first link, in order, from a page one level up. Most links start on the last level, which has none below."""
    last = depths.agg(F.max("depth").alias("last"))  # one row
    up = depths.crossJoin(F.broadcast(last)).where("depth < last").select(F.col("page_id").alias("from_id"), F.col("depth").alias("d0"))
    down = depths.select(F.col("page_id").alias("to_id"), F.col("depth").alias("d1"))
    both = edges.where("NOT nofollow").join(up, "from_id").join(down, "to_id").where("d1 = d0 + 1")
    return both.groupBy(F.col("to_id").alias("page_id")).agg(F.min_by("from_id", "edge_seq").alias("parent_id"))


def nearest_above(parents: DataFrame, wanted: Column) -> DataFrame:
    """page_id, above: the nearest ancestor for which wanted (a condition on at) holds; pages without one are left out."""
    up = parents.select(F.col("page_id").alias("at"), F.col("parent_id").alias("next"))
    going = parents.select("page_id", F.col("parent_id").alias("at"))
    found = going.where(wanted).select("page_id", F.col("at").alias("above"))
    for k in count(1):
        going = cut_lineage(going.where(~wanted).join(up, "at").select("page_id", F.col("next").alias("at")))
        if going.isEmpty():
            return found
        found = found.unionByName(going.where(wanted).select("page_id", F.col("at").alias("above")))
        if k % 8 == 0:
            found = cut_lineage(found)


def kept_pages(scores: DataFrame, parents: DataFrame, root: int, most: int) -> DataFrame:
    """page_id of the root, then of pages by score (ties to the smaller id) with all their ancestors, while they fit in most.

    A page whose missing ancestors do not fit is passed over for those that come after it. The need of a page is the best
    place of any page that hangs under it, or its own; pages of one need are what one page adds. Up to the first that does
    not fit the cut is one sort; then the same is done for the room left, with the pages whose missing ancestors fit in it.
    """
    place = F.struct((F.col("page_id") == root).alias("root"), "score", (-F.col("page_id")).alias("neg"))
    pool = cut_lineage(scores.join(parents, "page_id", "left").select("page_id", "parent_id", place.alias("place")))
    kept, left = pool.select("page_id").limit(0), most
    while True:
        up = pool.where("parent_id IS NOT NULL").select("page_id", "parent_id")
        need = going = pool.select("page_id", F.col("place").alias("need"))
        while True:
            going = cut_lineage(going.join(up, "page_id").groupBy(F.col("parent_id").alias("page_id")).agg(F.max("need").alias("need")))
            if going.isEmpty():
                break
            need = cut_lineage(need.unionByName(going.join(pool, "page_id", "left_semi")).groupBy("page_id").agg(F.max("need").alias("need")))
        # Every group has a page at least, so left + 1 of them are enough to see the first that does not fit.
        groups = need.groupBy("need").agg(F.count("*").alias("n")).orderBy(F.desc("need")).limit(left + 1).collect()
        last, room = None, left
        for g in groups:
            if g.n > room:
                break
            last, room = g.need, room - g.n
        else:
            return kept.unionByName(need.select("page_id"))
        if last is not None:
            end = F.struct(F.lit(last.root).alias("root"), F.lit(last.score).alias("score"), F.lit(last.neg).alias("neg"))
            kept = cut_lineage(kept.unionByName(need.where(F.col("need") >= end).select("page_id")))
        left = room
        if not left:
            return kept
        rest = cut_lineage(pool.join(kept, "page_id", "left_anti"))
        level = rest.join(rest.select(F.col("page_id").alias("parent_id")), "parent_id", "left_anti").select("page_id")
        fits = level
        for _ in range(left - 1):
            level = cut_lineage(rest.join(level.withColumnRenamed("page_id", "parent_id"), "parent_id", "left_semi").select("page_id"))
            if level.isEmpty():
                break
            fits = cut_lineage(fits.unionByName(level))
        pool = cut_lineage(rest.join(fits, "page_id", "left_semi").select("page_id", "parent_id", "place"))


def link_score(pages: DataFrame, edges: DataFrame, rounds: int = 30, damping: float = 0.85, cut_every: int = 1) -> DataFrame:
    """page_id, rank, score 1..100: PageRank over distinct followed links; pages without links give to all alike."""
    links = targets(edges, pages.select("page_id"))
    scores = scored(links, rounds, damping, cut_every)
    links.unpersist()
    return scores


def scored(links: DataFrame, rounds: int = 30, damping: float = 0.85, cut_every: int = 1) -> DataFrame:
    """link_score of targets() with a row for each page.

    Lineage is cut every round, as a round reads the ranks three times. Ranks go to where the links lie and what pages got is joined
    by a shuffle, so that neither passes the driver; ranks are rounded in the end, as sums depend on their order in the last digits.
    """
    n = links.count()
    ranks = cut_lineage(links.select(F.col("from_id").alias("page_id"), (F.size("to_ids") == 0).alias("dangling"), F.lit(1.0 / n).alias("rank")))
    for k in range(1, rounds + 1):
        giving = links.join(ranks.select(F.col("page_id").alias("from_id"), "rank").hint("merge"), "from_id")
        given = giving.select((F.col("rank") / F.size("to_ids")).alias("part"), F.explode("to_ids").alias("page_id")).groupBy("page_id").agg(F.sum("part").alias("got"))
        spread = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("spread"))  # one row
        ranks = ranks.join(given.hint("merge"), "page_id", "left").crossJoin(F.broadcast(spread)).select(
            "page_id", "dangling", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("spread") / n)).alias("rank")
        )
        if k % cut_every == 0:
            ranks = cut_lineage(ranks)
    ranks = ranks.withColumn("l", F.log(F.round("rank", 12)))
    ends = ranks.agg(F.min("l").alias("lo"), F.max("l").alias("hi"))
    flat = F.col("hi") - F.col("lo") < 1e-9
    score = F.when(flat, 100).otherwise(F.least(F.lit(100), F.greatest(F.lit(1), F.round(1 + 99 * (F.col("l") - F.col("lo")) / (F.col("hi") - F.col("lo"))))))
    return ranks.crossJoin(F.broadcast(ends)).select("page_id", F.round("rank", 9).alias("rank"), score.cast("int").alias("score"))


def redirect_ends(pages: DataFrame, hops: int = 10) -> DataFrame:
    """page_id, final_url, final_status, hops, error: where each redirect ends, followed through crawled pages.

    A chain that comes back to an address of its own is a 'loop', one that goes on after that many hops is 'too_many'; they
    have no end. A chain holds its addresses, hops + 1 at most.
    """
    step = pages.select(F.col("url").alias("at"), F.col("status").alias("s"), F.col("redirect_target").alias("next"))
    start = pages.where("redirect_target IS NOT NULL")
    going = start.select("page_id", F.col("redirect_target").alias("at"), F.lit(1).alias("hops"), F.array("url", "redirect_target").alias("seen"), (F.col("url") == F.col("redirect_target")).alias("loops"))
    failed = lambda rows, why: rows.select("page_id", F.lit(None).cast("string").alias("final_url"), F.lit(None).cast("int").alias("final_status"), "hops", F.lit(why).alias("error"))
    ended = None
    for k in range(hops):
        now = cut_lineage(going.join(step, "at", "left"))
        done = now.where("next IS NULL AND NOT loops").select("page_id", F.col("at").alias("final_url"), F.col("s").alias("final_status"), "hops", F.lit(None).cast("string").alias("error"))
        done = done.unionByName(failed(now.where("loops"), "loop"))
        ended = done if ended is None else ended.unionByName(done)
        left = now.where("next IS NOT NULL AND NOT loops")
        if k == hops - 1:
            return ended.unionByName(failed(left, "too_many"))
        going = left.select("page_id", F.col("next").alias("at"), (F.col("hops") + 1).alias("hops"), F.array_append("seen", F.col("next")).alias("seen"), F.array_contains("seen", F.col("next")).alias("loops"))
        if going.isEmpty():
            return ended
    return ended


def final_target(pages: DataFrame, hops: int = 10) -> DataFrame:
    """page_id, final_url, final_status, hops of the redirects that end."""
    return redirect_ends(pages, hops).where("error IS NULL").drop("error")


def inlink_samples(edges: DataFrame, problem: DataFrame, most: int = 20) -> DataFrame:
    """from_id, to_id, edge_seq: the first links to each page, and every link to a problem page."""
    w = Window.partitionBy("to_id").orderBy("edge_seq")
    first = edges.select("from_id", "to_id", "edge_seq").withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")
    bad = edges.select("from_id", "to_id", "edge_seq").join(problem.select(F.col("page_id").alias("to_id")), "to_id", "left_semi").select("from_id", "to_id", "edge_seq")
    return first.unionByName(bad).distinct()


def redirect_inlinks(pages: DataFrame, edges: DataFrame, most: int = 20_000) -> DataFrame:
    """to_id, from_id, edge_seq, inlinks_capped: the first links, in order, to pages that redirect; capped if there are most of them."""
    redirecting = pages.where("status BETWEEN 300 AND 399").select(F.col("page_id").alias("to_id"))
    first = edges.select("to_id", "from_id", "edge_seq").join(redirecting, "to_id", "left_semi").orderBy("edge_seq").limit(most)
    return first.crossJoin(F.broadcast(first.agg((F.count("*") >= most).alias("inlinks_capped"))))


def without_navigation(edges: DataFrame, parents: DataFrame, root: int, n_pages: Column | int) -> DataFrame:
    """Distinct links less those to the root, to pages that at least half of (ten or more) pages link, and the tree's own."""
    pairs = edges.where("from_id <> to_id").select("from_id", "to_id").distinct()
    popular = pairs.groupBy("to_id").agg(F.count("*").alias("n")).where((F.lit(n_pages) >= 10) & (2 * F.col("n") >= F.lit(n_pages)))
    tree = parents.select(F.col("parent_id").alias("from_id"), F.col("page_id").alias("to_id"))
    return pairs.where(F.col("to_id") != root).join(popular, "to_id", "left_anti").join(tree, ["from_id", "to_id"], "left_anti").select("from_id", "to_id")


def _subsets(words: Column) -> Column:
    """All subsets of an array, each in the array's order."""
    return F.aggregate(words, F.array(F.array().cast("array<string>")), lambda made, w: F.concat(made, F.transform(made, lambda s: F.array_append(s, w))))


def best_shared(wanting: DataFrame, offered: DataFrame, group: list[str], most: int = 6) -> DataFrame:
    """page_id, stand_in: for each page of wanting the page of offered in its group that shares most words with it; ties, and none
    shared, go to the smaller id. Both hold page_id, the group and words (distinct); a null in the group meets nothing.

    Words that all pages of a group hold, or that one side does not hold, decide nothing and are left out. What is left of a
    page, if it is no more than most words, is found by its subsets: each knows the least page that holds it, and the largest that a
    page finds is what it shares with its best. So pages are never paired. Only pages with more words left are paired, by each
    word, with the different sets of words of the other side.
    """
    key = [*group, "word"]
    tagged = wanting.select(*group, "page_id", "words", F.lit(True).alias("asks")).unionByName(offered.select(*group, "page_id", "words", F.lit(False).alias("asks")))
    tagged = tagged.dropna(subset=group)
    words = tagged.select(*group, "page_id", "asks", F.explode("words").alias("word"))
    held = words.groupBy(*key).agg(F.count_if("asks").alias("a"), F.count_if(~F.col("asks")).alias("b"))
    sizes = tagged.groupBy(*group).agg(F.count_if("asks").alias("all_a"), F.count_if(~F.col("asks")).alias("all_b"))
    telling = held.join(sizes, group).where("a > 0 AND b > 0 AND (a < all_a OR b < all_b)").select(*key)
    left = words.join(telling, key).groupBy("page_id", "asks").agg(F.array_sort(F.collect_list("word")).alias("words"))
    # Pages that hold the same words ask once and offer one page.
    sets = tagged.select(*group, "page_id", "asks").join(left, ["page_id", "asks"], "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    sets = cut_lineage(sets)
    asking = sets.where("asks").select(*group, "words").distinct()
    offers = sets.where("NOT asks").groupBy(*group, "words").agg(F.min("page_id").alias("stand_in"))
    few, many = F.size("words") <= most, F.size("words") > most

    named = offers.where(few).select(*group, F.explode(_subsets(F.col("words"))).alias("shared"), "stand_in").groupBy(*group, "shared").agg(F.min("stand_in").alias("stand_in"))
    met = asking.where(few).select(*group, "words", F.explode(_subsets(F.col("words"))).alias("shared")).join(named, [*group, "shared"])
    found = met.select(*group, "words", F.size("shared").alias("n"), "stand_in")

    def paired(asks: DataFrame, gives: DataFrame) -> DataFrame:
        """Pairs of sets that share a word; how many is counted by words, not by comparing sets."""
        one = asks.select(*group, "words", F.explode("words").alias("word")).join(gives.select(*group, "stand_in", F.explode("words").alias("word")), key)
        return one.groupBy(*group, "words", "stand_in").agg(F.count("*").cast("int").alias("n")).select(*group, "words", "n", "stand_in")

    least = offers.groupBy(*group).agg(F.min("stand_in").alias("stand_in"))
    none = asking.join(least, group).select(*group, "words", F.lit(0).alias("n"), "stand_in")
    found = found.unionByName(paired(asking.where(many), offers)).unionByName(paired(asking.where(few), offers.where(many))).unionByName(none)
    best = found.groupBy(*group, "words").agg(F.max(F.struct("n", (-F.col("stand_in")).alias("neg"))).alias("m"))
    return sets.where("asks").join(best, [*group, "words"]).select("page_id", (-F.col("m.neg")).alias("stand_in"))
