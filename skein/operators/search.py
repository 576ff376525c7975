"""Ranking: score = sum over query tokens of tf(t, d) * N / df(t) (J1-J3, A5,
O2, W1, W3).

* df defaults to N for a term the site has never seen (weight 1);
* duplicate query tokens count again (``qtf``);
* pages that match nothing keep score 0 and still fill the top k;
* ties break on ``doc_key`` ascending; scores are rounded to 6 places.

Plan: the query side (query terms joined with their weights) is small and
bounded by the query table, so it is broadcast after a size check and the
postings stream past it with no shuffle; only matching postings survive.  On a
stored index the query side is written first and carries the folder columns of
its sites and terms, so the scans of postings and document frequencies read
those folders only.  Beyond the bound the join is salted: a term's
postings spread over SALTS tasks by document, and the query side is repeated
once per salt.

Scores aggregate on (query, doc), spread over all tasks even when one query
matches a third of the corpus.  A contribution is added as two whole numbers
(units and 10^-12), so the sum, and with it the rank, does not depend on the
order in which tasks deliver.  Top-k per query is a row_number window that
Spark plans with a partial group limit before the shuffle, so at most k rows
per query leave each task.  Zero-score padding never forms queries x docs: a
query needs at most k filler pages, and the k smallest keys of its site always
contain enough unmatched ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.urls import site_hash, unquote
from skein.operators.analyze import query_terms
from skein.operators.broadcast import (MAX_BROADCAST_ROWS, broadcast_if_small,
                                       fits)
from skein.operators.index import doc_freq
from skein.operators.registry import is_indexed
from skein.session import materialize
from skein.sources.index_store import FIRST_KEYS, first_keys, site_bucket, with_buckets

SCORE_DIGITS = 6
SALTS = 64   # spread of one term's postings when the query side is not broadcast
#: Sums of doubles and rounded scores differ from exact ones by less than this.
MARGIN, RELATIVE = 2 * 10 ** -SCORE_DIGITS, 1e-9
FRACTION = 1_000_000_000_000   # parts of a unit in which contributions are added
CHUNK_PAGES, CHUNK_POSTINGS = 4096, 1 << 20   # of an index, scored at once, about
GROUP_QUERIES = 1 << 16   # queries that a chunk meets at once, about


def exact_sum(c: Column) -> Column:
    """The sum of contributions, none below 0, independent of their order."""
    whole = F.floor(c)
    part = F.round((c - whole) * FRACTION).cast("long")
    return F.sum(whole) + F.sum(part) / FRACTION


def with_folders(index: dict, df: DataFrame, term: bool = True) -> DataFrame:
    """``df`` (site, term) with the folder columns of a stored index."""
    return with_buckets(df, index["layout"], term) if "layout" in index else df


def shared(a: DataFrame, b: DataFrame, *keys: str) -> list[str]:
    """The join columns of two tables: ``keys``, and the folder columns that
    both have."""
    return [c for c in ("sb", "tb") if c in a.columns and c in b.columns] + list(keys)


def term_weights(doc_freq: DataFrame, doc_count: DataFrame, qterms: DataFrame,
                 small: bool | None = None) -> DataFrame:
    """(site, term, df, n, weight = n / coalesce(df, n)) for the terms
    the queries use.  ``small``: the query terms are known to be broadcastable."""
    if small is None:
        small = fits(qterms, MAX_BROADCAST_ROWS)
    keys = qterms.select(*shared(doc_freq, qterms, "site", "term")).distinct()
    keys = F.broadcast(keys) if small else keys
    on = shared(doc_freq, keys, "site", "term")
    # at most one row per query term: as small as the keys it was cut to
    dfq = doc_freq.join(keys, on, "inner")
    dfq = F.broadcast(dfq) if small else dfq
    return (keys.join(dfq, on, "left")
                .join(doc_count, shared(doc_count, keys, "site"), "inner")
                .select(*on, "df", "n", (F.col("n") / F.coalesce(F.col("df"), F.col("n"))).alias("weight")))


def docs_of(index: dict, site: str) -> DataFrame:
    """The docs of one site; of a stored index, only its folder is read."""
    docs = index["docs"].where(F.col("site") == site)
    return docs.where(F.col("sb") == site_bucket(F.lit(site), index["layout"][0])) if "layout" in index else docs


def pad_keys(index: dict, queries: DataFrame, k: int) -> DataFrame:
    """(site, doc_key): the ``k`` smallest keys of the sites that ``queries``
    ask; a stored index has them at hand."""
    sites = queries.select("site").distinct()
    sites = broadcast_if_small(with_folders(index, sites, term=False))
    if "keys" in index and k <= FIRST_KEYS:
        keys = index["keys"].where(F.col("rank") <= k)
        return keys.join(sites, shared(keys, sites, "site"), "left_semi").select("site", "doc_key")
    docs = index["docs"]
    docs = docs.join(sites, shared(docs, sites, "site"), "left_semi")
    return first_keys(docs, k).select("site", "doc_key")


def salted_join(postings: DataFrame, qw: DataFrame, salts: int) -> DataFrame:
    """Postings x query side on (site, term) without a hot term in one task:
    each posting gets salt = hash(doc_key) mod ``salts`` and every query-side
    row is repeated once per salt, so a term's postings spread over ``salts``
    tasks and each still meets every query row exactly once."""
    p = postings.withColumn("_salt", F.pmod(F.hash("doc_key"), F.lit(salts)))
    q = qw.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return p.join(q, [*shared(p, q, "site", "term"), "_salt"], "inner").drop("_salt")


def score_candidates(index: dict, queries: DataFrame, k: int | None = 10,
                     irregular: bool = True, qterms: DataFrame | None = None,
                     max_broadcast_rows: int = MAX_BROADCAST_ROWS,
                     salts: int = SALTS) -> DataFrame:
    """(query_id, site, doc_key, score) for every matched page, plus k
    zero-score candidates per query when ``k`` is given."""
    qt = query_side(index, with_folders(index, qterms if qterms is not None else query_terms(queries, irregular)))
    # the query side is bounded by the query table: size-check it there, not
    # after joining the index statistics (which would run the index build)
    small = fits(qt, max_broadcast_rows)
    if "layout" not in index:
        index = asked_part(index, qt, small, salts)
    qw = query_side(index, weighted_terms(index, qt, small))
    if small:
        post = index["postings"]
        joined = post.join(F.broadcast(qw), shared(post, qw, "site", "term"), "inner")
    else:
        joined = salted_join(index["postings"], qw, salts)
    contrib = joined.select("query_id", "site", "doc_key", (F.col("tf") * F.col("qw")).alias("c"))
    if k is not None:
        contrib = contrib.unionByName(padding(index, queries, k))
    return scores_of(contrib)


def asked_part(index: dict, qterms: DataFrame, small: bool, salts: int = SALTS) -> dict:
    """The index with the postings of the terms asked, written once: what is
    taken from them reads no text again.  Document frequencies are counted
    from them where the index's own are such counts."""
    post = index["postings"]
    terms = qterms.select(*shared(post, qterms, "site", "term")).distinct()
    found = post.join(F.broadcast(terms), shared(post, terms, "site", "term")) if small else salted_join(post, terms, salts)
    found = materialize(found.select("site", "doc_key", "term", "tf"), "search-postings")
    counted = index.get("counted")
    out = {name: df for name, df in index.items() if name != "layout"}
    return {**out, "postings": found, "doc_freq": doc_freq(found) if counted else index["doc_freq"]}


def query_side(index: dict, terms: DataFrame) -> DataFrame:
    """Query terms as the side that prunes the folders of a stored index: they
    are written first (they are as small as the queries), since Spark prunes
    at run time by a side whose plan it can recognise and that has a filter."""
    return materialize(terms, "query-terms").where("term <> ''") if "layout" in index else terms


def weighted_terms(index: dict, qterms: DataFrame, small: bool | None = None) -> DataFrame:
    """(query_id, site, term, qw): what one occurrence of a term adds."""
    weights = term_weights(index["doc_freq"], index["doc_count"], qterms, small)
    on = shared(qterms, weights, "site", "term")
    return qterms.join(weights, on, "inner").select("query_id", *on, (F.col("qtf") * F.col("weight")).alias("qw"))


def padding(index: dict, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, site, doc_key, c = 0): k fillers a query."""
    pads = broadcast_if_small(pad_keys(index, queries, k))
    return (queries.select("query_id", "site").distinct().join(pads, "site", "inner")
                   .select("query_id", "site", "doc_key", F.lit(0.0).alias("c")))


def scores_of(contrib: DataFrame) -> DataFrame:
    return contrib.groupBy("query_id", "site", "doc_key").agg(F.round(exact_sum(F.col("c")), SCORE_DIGITS).alias("score"))


def best_of(scores: DataFrame, index: dict, k: int) -> DataFrame:
    """(query_id, rank, doc_key, url, score, no_of_docs) of the k best."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_key"))
    top = (scores.withColumn("rank", F.row_number().over(w))
                 .where(F.col("rank") <= k))
    counts = index["doc_count"].select("site", F.col("n").alias("no_of_docs"))
    return (top.join(counts, "site", "inner")
               .select("query_id", "rank", "doc_key", unquote(F.col("doc_key")).alias("url"),
                       "score", "no_of_docs"))


def search_batch(index: dict, queries: DataFrame, k: int = 10,
                 irregular: bool = True, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Top-k pages for every query of a query table (query_id, site, query).

    Returns (query_id, rank, doc_key, url, score, no_of_docs)."""
    if "layout" not in index:
        return search_asked(index, queries, k, irregular, max_broadcast_rows)
    scores = score_candidates(index, queries, k, irregular,
                              max_broadcast_rows=max_broadcast_rows)
    return best_of(scores, index, k)


def search_indexed(index: dict, requests: DataFrame, sites: DataFrame, k: int = 10) -> DataFrame:
    """The offline route: ``requests`` (query_id, host, query) whose host is in
    the registry (``sites``) are answered from the host's pages, with query
    words stemmed as the offline ranking does; the others get no rows."""
    known = is_indexed(requests.select("host").distinct(), sites).where("indexed").select("host")
    asked = requests.join(known, "host", "left_semi")
    return search_asked(index, asked.select("query_id", site_hash(F.col("host")).alias("site"), "query"), k, irregular=False)


def profiles(queries: DataFrame, qterms: DataFrame) -> DataFrame:
    """(query_id, profile): queries of one profile ask the same terms, each as
    often, of the same sites, so they have one answer."""
    asked = queries.select("query_id", "site", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("qtf"))
    every = asked.distinct().unionByName(qterms.select(*asked.columns))
    terms = F.sort_array(F.collect_list(F.struct("site", "term", "qtf")))
    return every.groupBy("query_id").agg(F.sha2(F.to_json(terms), 256).alias("profile"))


def search_asked(index: dict, queries: DataFrame, k: int, irregular: bool = True,
                 max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """W1 with each profile of queries answered once, from the pages that can
    be among its k best.  Each stage is written to the shared folder."""
    qt = materialize(query_terms(queries, irregular), "query-terms")
    named = materialize(profiles(queries, qt), "query-profiles")
    some = broadcast_if_small(named, max_broadcast_rows)

    def by_profile(df: DataFrame) -> DataFrame:
        both = df.withColumnRenamed("query_id", "_id").join(some, F.col("_id").eqNullSafe(F.col("query_id")))
        return both.drop("_id", "query_id").withColumnRenamed("profile", "query_id").distinct()

    qt = materialize(by_profile(qt).select("query_id", "site", "term", "qtf"), "profile-terms")
    asked = by_profile(queries.select("query_id", "site"))
    scores = best_scores(index, qt, k, max_broadcast_rows)
    pads = padding(index, asked, k).select("query_id", "site", "doc_key", F.col("c").alias("score"))
    every = scores.unionByName(pads).groupBy("query_id", "site", "doc_key").agg(F.max("score").alias("score"))
    top = materialize(best_of(every, index, k).withColumnRenamed("query_id", "profile"), "search-top")
    return named.join(broadcast_if_small(top, max_broadcast_rows), "profile").select(
        "query_id", *[c for c in top.columns if c != "profile"])


def kth_score(scores: DataFrame, k: int) -> DataFrame:
    """(query_id, kth): the k-th score of queries with that many pages."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("site"), F.asc("doc_key"))
    return scores.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") == k).select("query_id", "kth")


def scored(postings: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """(q, page, whole, part): of each query the pages of a chunk that can be
    among its ``k`` best, with the sums of their contributions.  ``postings``
    (t, page, tf): pages are numbered in the order of their keys; ``queries``
    (q, kth, terms): terms as (t, qw).  A query that no page of the chunk can
    reach ``kth`` in is left out, by the greatest tf of its terms here."""
    found: list[list] = [[], [], [], []]
    if len(postings) and len(queries):
        t, page, tf = (postings[c].to_numpy() for c in ("t", "page", "tf"))
        order = np.lexsort((page, t))
        t, page, tf = t[order], page[order], tf[order]
        pages, at_page = np.unique(page, return_inverse=True)
        known, first = np.unique(t, return_index=True)
        last = np.append(first[1:], len(t))
        pair = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (page[1:] != page[:-1])))
        most = np.maximum.reduceat(np.add.reduceat(tf, pair), np.searchsorted(pair, first))
        lists = queries["terms"].combine_chunks()
        cut, flat = np.append(0, np.cumsum(lists.value_lengths().to_numpy())), lists.flatten()
        term, qw = flat.field("t").to_numpy(), flat.field("qw").to_numpy()
        at = np.minimum(np.searchsorted(known, term), len(known) - 1)
        held = known[at] == term
        row = np.repeat(np.arange(len(queries)), np.diff(cut))[held]
        at, qw, cut = at[held], qw[held], np.append(0, np.cumsum(np.bincount(row, minlength=len(queries))))
        reach = np.bincount(row, most[at] * qw, len(queries)) * (1 + RELATIVE) + MARGIN
        kth = queries["kth"].to_numpy()          # null: nan, which no comparison holds for
        for r in np.flatnonzero((np.diff(cut) > 0) & ~(reach < kth)).tolist():
            here = at[cut[r]:cut[r + 1]]
            many = last[here] - first[here]
            posting = np.arange(many.sum()) + np.repeat(first[here] - np.cumsum(many) + many, many)
            c = tf[posting] * np.repeat(qw[cut[r]:cut[r + 1]], many)
            floor = np.floor(c)
            rest = (c - floor) * FRACTION
            half = np.floor(rest)
            half += rest - half >= 0.5
            whole, part = np.zeros(len(pages), np.int64), np.zeros(len(pages), np.int64)
            p = at_page[posting]
            np.add.at(whole, p, floor.astype(np.int64))
            np.add.at(part, p, half.astype(np.int64))
            score = whole + part / FRACTION
            seen = np.zeros(len(pages), bool)
            seen[p] = True
            best = np.flatnonzero(seen)
            if len(best) > k:
                low = np.partition(score[best], -k)[-k]
                # rounding may make scores equal; of equal ones the first keys are the best
                best = best[score[best] >= low - MARGIN - abs(low) * RELATIVE]
                best = best[np.lexsort((best, -score[best]))]
                n = np.arange(len(best))
                same = np.append(False, score[best[1:]] == score[best[:-1]])
                best = best[n - np.maximum.accumulate(np.where(same, 0, n)) < k]
            for out, x in zip(found, (np.full(len(best), r), pages[best], whole[best], part[best])):
                out.append(x)
    r, *rest = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in found)
    q = queries["q"].to_numpy()[r] if len(r) else r
    return pa.table([pa.array(c, pa.int64()) for c in (q, *rest)], names=["q", "page", "whole", "part"])


def chunked(postings: DataFrame) -> DataFrame:
    """(site, doc_key, page, size, part): the pages, numbered in the order of
    their keys, in chunks of about CHUNK_PAGES or CHUNK_POSTINGS.  A chunk of a
    site with more holds pages of like length, so that the greatest tf of its
    terms bounds them well."""
    pages = postings.groupBy("site", "doc_key").agg(F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("length"))
    pages = pages.withColumn("size", F.floor(F.log2(F.greatest(F.col("length"), F.lit(1))))).drop("length")
    pages = materialize(pages.orderBy("site", "doc_key").withColumn("page", F.monotonically_increasing_id()), "search-pages")
    parts = lambda n, terms: F.ceil(F.greatest(n / CHUNK_PAGES, terms / CHUNK_POSTINGS))
    sizes = pages.groupBy("site", "size").agg(F.count(F.lit(1)).alias("n"), F.sum("terms").alias("m"))
    site = Window.partitionBy("site")
    sizes = sizes.select("site", "size", parts(F.col("n"), F.col("m")).alias("parts"),
                         (parts(F.sum("n").over(site), F.sum("m").over(site)) <= 1).alias("one"))
    sizes = broadcast_if_small(materialize(sizes, "search-sizes"))
    return pages.join(sizes, ["site", "size"]).select(
        "site", "doc_key", "page", F.when(F.col("one"), F.lit(-1)).otherwise(F.col("size")).alias("size"),
        F.pmod(F.xxhash64("page"), F.when(F.col("one"), F.lit(1)).otherwise(F.col("parts"))).alias("part"))


def best_scores(index: dict, qterms: DataFrame, k: int, max_broadcast_rows: int = MAX_BROADCAST_ROWS,
                salts: int = SALTS) -> DataFrame:
    """(query_id, site, doc_key, score) of all pages that can be among the k
    best of their query, and of others.

    The k postings with the greatest tf of each term give a score that k pages
    reach.  Pages are scored by the chunk: its postings, sorted by term, meet
    the queries of its site, and of each query the pages that can be among its
    k best there are kept; so what leaves a task grows with the queries and
    chunks, not with the pages that a query's terms meet."""
    qt = with_folders(index, qterms)
    small = fits(qt, max_broadcast_rows)
    part = asked_part(index, query_side(index, qt), small, salts)
    post = part["postings"]
    qw = weighted_terms(part, qterms if part.get("counted") else qt, small)
    qw = materialize(qw.select("query_id", "site", "term", "qw"), "query-weights")
    side = lambda df: F.broadcast(df) if small else df  # noqa: E731  at most as many rows as query terms

    first = Window.partitionBy("site", "term").orderBy(F.desc("tf"), F.asc("doc_key"))
    heads = materialize(post.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= k).drop("_rn"), "search-heads")
    low = heads.join(side(qw), ["site", "term"]).groupBy("query_id", "site", "doc_key").agg(
        F.sum(F.col("tf") * F.col("qw")).alias("score"))
    kth = kth_score(low, k)

    # terms and queries by number, a row a query
    terms = materialize(qw.select("site", "term").distinct().withColumn("t", F.monotonically_increasing_id()), "search-terms")
    asked = qw.join(side(terms), ["site", "term"]).groupBy("query_id", "site").agg(
        F.collect_list(F.struct("t", "qw")).alias("terms")).join(kth, "query_id", "left")
    asked = materialize(asked.withColumn("q", F.monotonically_increasing_id()), "search-asked")
    groups = F.lit(asked.count() // GROUP_QUERIES + 1)
    pages = materialize(chunked(post), "search-chunks")
    some = broadcast_if_small(pages.select(F.col("site").alias("_site"), F.col("doc_key").alias("_key"), "page", "size", "part"))
    left = post.join(side(terms), ["site", "term"])
    left = left.join(some, (F.col("site") == F.col("_site")) & F.col("doc_key").eqNullSafe(F.col("_key")))
    left = left.select("site", "size", "part", F.explode(F.sequence(F.lit(0), groups - 1)).alias("g"), "t", "page", "tf")
    chunks = pages.select("site", "size", "part").distinct().toDF("on", "chunk", "slice")
    right = asked.join(broadcast_if_small(chunks), F.col("site") == F.col("on")).select(
        "on", "chunk", "slice", F.pmod(F.xxhash64("q"), groups).cast("int").alias("h"), "q", "kth", "terms")
    keys = ("site", "size", "part", "g"), ("on", "chunk", "slice", "h")
    met = left.groupBy(*keys[0]).cogroup(right.groupBy(*keys[1])).applyInArrow(
        lambda x, y: scored(x, y, k), "q bigint, page bigint, whole bigint, part bigint")
    met = materialize(met, "search-met").join(broadcast_if_small(asked.select("q", "query_id")), "q")
    met = met.join(broadcast_if_small(pages.select("page", "site", "doc_key")), "page")
    return met.select("query_id", "site", "doc_key", F.round(F.col("whole") + F.col("part") / FRACTION, SCORE_DIGITS).alias("score"))


def single_query(site: str, query: str, spark, query_id: int = 0) -> DataFrame:
    return spark.createDataFrame([(query_id, site, query)],
                                 "query_id bigint, site string, query string")


def search_topk(index: dict, site: str, query: str, k: int = 10,
                irregular: bool = True) -> DataFrame:
    """O2: top-k pages for one query on one site: (site, rank, doc_key, url,
    score).  orderBy + limit plans as TakeOrderedAndProject (a per-task top-k
    merged on one task, k rows each)."""
    spark = index["docs"].sparkSession
    q = single_query(site, query, spark)
    scores = score_candidates(index, q, k, irregular)
    top = scores.orderBy(F.desc("score"), F.asc("doc_key")).limit(k)
    w = Window.partitionBy("site").orderBy(F.desc("score"), F.asc("doc_key"))
    return top.select("site", F.row_number().over(w).alias("rank"), "doc_key",
                      unquote(F.col("doc_key")).alias("url"), "score")


def search_all_docs(index: dict, site: str, query: str, irregular: bool = True) -> DataFrame:
    """Every page of the site with its score (0.0 when nothing matches)."""
    spark = index["docs"].sparkSession
    q = single_query(site, query, spark)
    scores = score_candidates(index, q, None, irregular).select("site", "doc_key", "score")
    return (docs_of(index, site).select("site", "doc_key")
            .join(scores, ["site", "doc_key"], "left")
            .select("doc_key", F.coalesce(F.col("score"), F.lit(0.0)).alias("score")))


def search_answer(index: dict, site: str, query: str, k: int = 10,
                  irregular: bool = True) -> DataFrame:
    """The search route's answer: ranked URLs plus the page count N."""
    top = search_topk(index, site, query, k, irregular)
    counts = index["doc_count"].select("site", F.col("n").alias("no_of_docs"))
    return top.join(counts, "site", "inner").select("rank", "url", "no_of_docs")
