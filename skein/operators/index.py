"""Index construction: docs -> postings, document frequency, document count.

Shapes (see ``skein.schemas``):
  docs      (site, doc_key, url, text)   text whitespace-collapsed
  postings  (site, doc_key, term, tf)    unique per (site, doc_key, term)
  doc_freq  (site, term, df)
  doc_count (site, n)                    counts pages with no term too
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import collapse_ws, page_text
from skein.functions.urls import doc_key, site_key
from skein.operators.analyze import page_entries, term_counts, term_pages
from skein.operators.broadcast import broadcast_if_small


def docs_from_documents(documents: DataFrame, site_col: str = "source",
                        site: str | None = None) -> DataFrame:
    """The driver's ``documents`` table as index input: one site per
    ``source`` (or the single ``site`` given), key = doc_id."""
    key = F.col("doc_id").cast("string")
    site_c = F.lit(site) if site is not None else F.col(site_col)
    return documents.select(site_c.alias("site"), key.alias("doc_key"), key.alias("url"),
                            collapse_ws(F.col("text")).alias("text"))


def docs_from_pages(pages: DataFrame, site_col: str | None = None) -> DataFrame:
    """Fetched pages as index input: site = sha256(host) (or the crawl's own
    ``site_col``), key = the whole quoted URL."""
    site = F.col(site_col) if site_col else site_key(F.col("url"))
    return pages.select(site.alias("site"), doc_key(F.col("url")).alias("doc_key"),
                        F.col("url"), page_text(F.col("html")).alias("text"))


def term_freq(docs: DataFrame, stopwords="nltk", keys=("site", "doc_key")) -> DataFrame:
    """A1: postings, one row per (document, term).  Texts are dealt by document
    and their terms counted as they stream by, so that no task holds more than
    the texts it sorts.  ``keys`` are the columns that name a document."""
    return term_counts(docs, stopwords, keys=keys)


def doc_freq(postings: DataFrame) -> DataFrame:
    """A2: number of documents per (site, term); postings are unique per
    (doc, term), so a plain count is exact.  Hot terms are pre-aggregated
    map-side before the shuffle."""
    return postings.groupBy("site", "term").agg(F.count(F.lit(1)).alias("df"))


def doc_count(docs: DataFrame) -> DataFrame:
    """A4: N per site, including documents without any surviving term."""
    return docs.groupBy("site").agg(F.count(F.lit(1)).alias("n"))


def page_freq(docs: DataFrame, stopwords="nltk") -> DataFrame:
    """A2 from the docs themselves: ``doc_freq`` of their ``term_freq``, with
    the pages of a term counted where its postings are made."""
    return term_pages(docs, stopwords).groupBy("site", "term").agg(F.sum("df").alias("df"))


def build_index(docs: DataFrame, stopwords="nltk") -> dict[str, DataFrame]:
    return {"docs": docs, "postings": term_freq(docs, stopwords), "doc_freq": page_freq(docs, stopwords),
            "doc_count": doc_count(docs), "counted": True}     # doc_freq counts these postings


def top_terms(postings: DataFrame, k: int | None = None) -> DataFrame:
    """O1: the terms of each page in order (tf desc, term asc): all of them,
    or the ``k`` first."""
    w = Window.partitionBy("site", "doc_key").orderBy(F.desc("tf"), F.asc("term"))
    ranked = postings.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def postings_map(postings: DataFrame, by_page: bool = False) -> DataFrame:
    """(site, doc_key, terms map<string,bigint>) - the per-page document
    form; entries sorted by tf desc then term for a stable JSON rendering.
    Pages are formed as their postings stream by, one held at a time.
    ``by_page``: those of a page follow each other in a task, as ``term_freq``
    gives them; others are dealt and sorted by page."""
    if not by_page:
        postings = postings.repartition("site", "doc_key").sortWithinPartitions("site", "doc_key")
    return page_entries(postings).select("site", "doc_key", F.map_from_entries("e").alias("terms"))


def superseded(versions: DataFrame, order_col: str = "version") -> DataFrame:
    """(site, doc_key, version) for which ``versions`` has a newer one; reads
    key columns only."""
    keys = ["site", "doc_key"]
    pairs = versions.select(*keys, order_col)
    several = pairs.groupBy(*keys).agg(F.max(order_col).alias("_newest"), F.min(order_col).alias("_oldest"))
    several = several.where("_newest > _oldest").drop("_oldest")
    old = pairs.join(broadcast_if_small(several), keys).where(F.col(order_col) < F.col("_newest"))
    return old.select(*keys, order_col).distinct()


def without(versions: DataFrame, old: DataFrame, order_col: str = "version") -> DataFrame:
    """``versions`` less the ``old`` ones: where these are few they are sent to
    the rows, so that no text is sorted or shuffled."""
    return versions.join(broadcast_if_small(old), ["site", "doc_key", order_col], "left_anti")


def latest_versions(versions: DataFrame, order_col: str = "version") -> DataFrame:
    """Keep the newest version of every (site, doc_key) - the overwrite rule
    of a re-crawled page.  A version has one row a page.  What is replaced is
    found on the keys alone, so no text takes part in an aggregation."""
    return without(versions, superseded(versions, order_col), order_col)


def doc_freq_delta(new_postings: DataFrame, replaced_postings: DataFrame) -> DataFrame:
    """DF change caused by a batch: +1 per new (doc, term), -1 per replaced one."""
    plus = new_postings.select("site", "term", F.lit(1).cast("long").alias("df"))
    minus = replaced_postings.select("site", "term", F.lit(-1).cast("long").alias("df"))
    return (plus.unionByName(minus).groupBy("site", "term")
                .agg(F.sum("df").alias("df")))


def merge_doc_freq(doc_freq_old: DataFrame, delta: DataFrame) -> DataFrame:
    """A3: add a batch's DF delta to the stored DF; terms reaching 0 vanish."""
    return (doc_freq_old.select("site", "term", "df").unionByName(delta)
                        .groupBy("site", "term").agg(F.sum("df").alias("df"))
                        .where(F.col("df") > 0))
