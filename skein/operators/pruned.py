"""Exact top-k that leaves out blocks of pages which cannot reach it (O2, W1,
W3 over a stored index).

``bounds`` holds the greatest tf of each (term, block).  For a query and a
block, the sum of the bounds over the query's terms is more than any page of
the block can score, and the greatest single one is less than its best page
scores.

1. The k blocks with the greatest single bound are scored whole.  Each has a
   page that scores as much, so the k-th score found there is high.
2. Blocks whose sum of bounds is below that k-th score cannot hold a page of
   the top k; the others are scored, and the best of both are ranked.

The rows of postings that are read are those of blocks that remain: folders
are pruned by the query's sites and terms, and where the terms are few their
places in the sort order reach the scan as a filter, too.  Both passes read
the small ``bounds`` instead of postings.  What each pass finds is written to
the shared folder, so the size of what is broadcast is known.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.analyze import query_terms
from skein.operators.broadcast import broadcast_if_small
from skein.operators.search import (MARGIN, RELATIVE, best_of, exact_sum, padding, query_side, scores_of, shared,
                                    single_query, weighted_terms, with_folders)
from skein.session import materialize

#: Terms whose places in the sort order are put into the filter of the scan.
FILTER_TERMS = 64


def block_bounds(index: dict, qw: DataFrame) -> DataFrame:
    """(query_id, site, block, most, least): no page of the block scores more
    than ``most``, and its best page scores ``least`` or more."""
    b = index["bounds"]
    side = broadcast_if_small(qw)
    joined = b.join(side, shared(b, side, "site", "term")).select(
        "query_id", "site", "block", (F.col("max_tf") * F.col("qw")).alias("c"))
    return joined.groupBy("query_id", "site", "block").agg(exact_sum(F.col("c")).alias("most"), F.max("c").alias("least"))


def narrowed(index: dict, wanted: DataFrame) -> DataFrame:
    """The postings, filtered by the places of the ``wanted`` (site, term,
    block) in the sort order where few terms are asked: one row a term comes
    to the driver, FILTER_TERMS at most."""
    post = index["postings"]
    terms = wanted.groupBy("sb", "tb", "site", "term").agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
    rows = terms.limit(FILTER_TERMS + 1).collect()
    if not rows or len(rows) > FILTER_TERMS:
        return post
    place = [(F.col("sb") == r["sb"]) & (F.col("tb") == r["tb"]) & (F.col("site") == r["site"])
             & (F.col("term") == r["term"]) & F.col("block").between(r["lo"], r["hi"]) for r in rows]
    return post.where(reduce(lambda a, b: a | b, place))


def score_blocks(index: dict, qw: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query_id, site, doc_key, score) of every page with a term of the query
    in the stored ``blocks`` (query_id, site, block)."""
    wanted = query_side(index, blocks.join(broadcast_if_small(qw), ["query_id", "site"]))
    post = narrowed(index, wanted)
    side = broadcast_if_small(wanted)
    joined = post.join(side, shared(post, side, "site", "term", "block"))
    return scores_of(joined.select("query_id", "site", "doc_key", (F.col("tf") * F.col("qw")).alias("c")))


def ranked(df: DataFrame, k: int, *order) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def candidate_scores(index: dict, queries: DataFrame, k: int, irregular: bool = True,
                     qterms: DataFrame | None = None) -> DataFrame:
    """Scores of all pages that can be among the k best of their query."""
    qt = query_side(index, with_folders(index, qterms if qterms is not None else query_terms(queries, irregular)))
    qw = query_side(index, weighted_terms(index, qt))
    bounds = materialize(block_bounds(index, qw), "search-bounds")
    seeds = materialize(ranked(bounds, k, F.desc("least"), F.asc("block")).select("query_id", "site", "block"), "search-seeds")
    first = materialize(score_blocks(index, qw, seeds), "search-first")
    # a query that has found k pages needs no more than the k-th score
    reached = ranked(first, k, F.desc("score"), F.asc("doc_key")).groupBy("query_id").agg(
        F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
    reached = broadcast_if_small(materialize(reached.select("query_id", "kth"), "search-kth"))
    open_ = bounds.join(reached, "query_id", "left").where(
        F.col("kth").isNull() | (F.col("most") * (1 + RELATIVE) + MARGIN >= F.col("kth")))
    more = open_.join(broadcast_if_small(seeds), ["query_id", "site", "block"], "left_anti")
    more = materialize(more.select("query_id", "site", "block"), "search-more")
    return first.unionByName(score_blocks(index, qw, more))


def search_batch(index: dict, queries: DataFrame, k: int = 10, irregular: bool = True) -> DataFrame:
    """W1 over a stored index: as ``search.search_batch``, and equal to it."""
    scores = candidate_scores(index, queries, k, irregular)
    pads = scores_of(padding(index, queries, k))
    every = scores.unionByName(pads).groupBy("query_id", "site", "doc_key").agg(F.max("score").alias("score"))
    return best_of(every, index, k)


def search_topk(index: dict, site: str, query: str, k: int = 10, irregular: bool = True) -> DataFrame:
    """O2 over a stored index: (site, rank, doc_key, url, score)."""
    q = single_query(site, query, index["docs"].sparkSession)
    return search_batch(index, q, k, irregular).select(F.lit(site).alias("site"), "rank", "doc_key", "url", "score")


def search_answer(index: dict, site: str, query: str, k: int = 10, irregular: bool = True) -> DataFrame:
    """W3 over a stored index: (rank, url, no_of_docs)."""
    q = single_query(site, query, index["docs"].sparkSession)
    return search_batch(index, q, k, irregular).select("rank", "url", "no_of_docs")
