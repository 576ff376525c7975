"""Site bundle import / export (S7, S8): the downloadable per-site layout.

Layout of a bundle directory::

  index/<key>   one JSON object per page: {"term": tf, ...}, tf descending
  data/<key>    the page's whitespace-collapsed text
  doc_freq      one JSON object: {"term": df, ...}

where <key> is the page URL percent-encoded with no safe characters and cut
at 201 characters.  Import reads every file as one row (``wholetext``), so
work spreads over files; export writes JSON lines (one page per line, one
(term, df) per line) rather than one file per page, so no single task or
row ever holds a whole site.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.urls import unquote
from skein.operators.index import doc_freq as count_pages, postings_map


def _key_from_file(col: str = "_metadata.file_name") -> F.Column:
    # the file name comes back percent-encoded once more: decode it once,
    # shielding '+' which is a literal in these names
    name = F.col(col)
    return F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)


def import_bundle(spark: SparkSession, root: str, site: str) -> dict:
    """Docs, postings, doc_freq and doc_count of one site from a bundle.
    DF is recounted from the postings: the stored file loses counts over
    rounds, and holds a site's vocabulary in one row."""
    idx_files = (spark.read.option("wholetext", True).text(os.path.join(root, "index"))
                 .select(_key_from_file().alias("doc_key"), F.col("value")))
    data_files = (spark.read.option("wholetext", True).text(os.path.join(root, "data"))
                  .select(_key_from_file().alias("doc_key"), F.col("value").alias("text")))
    docs = data_files.select(F.lit(site).alias("site"), "doc_key",
                             unquote(F.col("doc_key")).alias("url"), "text")
    postings = (idx_files.select("doc_key", F.explode(F.from_json("value", "map<string,bigint>"))
                                 .alias("term", "tf"))
                .select(F.lit(site).alias("site"), "doc_key", "term", "tf"))
    doc_freq = count_pages(postings)
    # N counts index files, so a page whose map is empty still counts
    doc_count = idx_files.groupBy().agg(F.count(F.lit(1)).alias("n")) \
                         .select(F.lit(site).alias("site"), "n")
    return {"docs": docs, "postings": postings, "doc_freq": doc_freq, "doc_count": doc_count}


def export_rows(index: dict, site: str) -> dict[str, DataFrame]:
    """S8 as DataFrames: per-page JSON maps, page texts, DF rows of a site."""
    post = index["postings"].where(F.col("site") == site)
    pages = postings_map(post).select("doc_key", F.to_json("terms").alias("json"))
    # pages without any term still get an empty map
    docs = index["docs"].where(F.col("site") == site).select("doc_key", "text")
    pages = docs.select("doc_key").join(pages, "doc_key", "left").select(
        "doc_key", F.coalesce(F.col("json"), F.lit("{}")).alias("json"))
    dfreq = index["doc_freq"].where(F.col("site") == site).select("term", "df")
    return {"index": pages, "data": docs, "doc_freq": dfreq}


def export_bundle(index: dict, site: str, root: str) -> None:
    """Write the export rows as JSON lines under ``root``."""
    for name, df in export_rows(index, site).items():
        df.write.mode("overwrite").json(os.path.join(root, name))


def import_export(spark: SparkSession, root: str, site: str) -> dict:
    """S7 for what ``export_bundle`` wrote: the same tables, DF recounted."""
    read = lambda name, schema: spark.read.schema(schema).json(os.path.join(root, name))
    pages = read("index", "doc_key string, json string")
    docs = read("data", "doc_key string, text string").select(
        F.lit(site).alias("site"), "doc_key", unquote(F.col("doc_key")).alias("url"), "text")
    postings = pages.select(F.lit(site).alias("site"), "doc_key",
                            F.explode(F.from_json("json", "map<string,bigint>")).alias("term", "tf"))
    doc_count = pages.agg(F.count(F.lit(1)).alias("n")).select(F.lit(site).alias("site"), "n")
    return {"docs": docs, "postings": postings, "doc_freq": count_pages(postings), "doc_count": doc_count}
