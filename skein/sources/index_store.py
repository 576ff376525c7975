"""Index storage (S2-S4): Parquet tables under one root, laid out by buckets.

  docs       sb=<n>/         (site, doc_key, url, text)
  keys       sb=<n>/         (site, doc_key, rank)      the first keys of a site
  doc_count  sb=<n>/         (site, n)
  postings   sb=<n>/tb=<n>/  (site, doc_key, term, tf, block)
  bounds     sb=<n>/tb=<n>/  (site, term, block, max_tf, n)
  doc_freq   sb=<n>/tb=<n>/  (site, term, df)
  layout                     (site_buckets, term_buckets), one row

``sb`` is a bucket of the site and ``tb`` one of (site, term).  Both are
partition folders, so a search whose query side carries them reads the folders
of its own sites and terms only: they reach the scan as partition filters,
static for one site and dynamic from a joined query table.  The number of
folders does not grow with the sites.

A site's pages are dealt into blocks of about ``BLOCK_DOCS`` by a hash of their
key; ``bounds`` holds the greatest tf of each (term, block), from which a
search can tell blocks that cannot reach its top k.  Rows are range-partitioned
by their whole sort key before they are written: a term that covers a third of
all postings spreads over tasks, and there are at most folders + tasks files.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from skein import schemas
from skein.operators.broadcast import broadcast_if_small
from skein.session import materialize
from skein.sources.tables import is_missing

SITE_BUCKETS, TERM_BUCKETS = 8, 16
BLOCK_DOCS = 128
#: Keys of a site kept for padding a result; a longer one reads the docs.
FIRST_KEYS = 1000
#: Rows of a Parquet page: the unit that a filter on the sort key can skip.
PAGE_ROWS = 2000

_SB = [StructField("sb", IntegerType())]
_TB = [*_SB, StructField("tb", IntegerType())]
_TEXT = lambda *names: [StructField(n, StringType()) for n in names]
TABLES = {
    "docs": StructType([*schemas.DOCS.fields, *_SB]),
    "keys": StructType([*_TEXT("site", "doc_key"), StructField("rank", IntegerType()), *_SB]),
    "doc_count": StructType([*schemas.DOC_COUNT.fields, *_SB]),
    "postings": StructType([*schemas.POSTINGS.fields, StructField("block", LongType()), *_TB]),
    "bounds": StructType([*_TEXT("site", "term"), StructField("block", LongType()), StructField("max_tf", LongType()),
                          StructField("n", LongType()), *_TB]),
    "doc_freq": StructType([*schemas.DOC_FREQ.fields, *_TB]),
}
SORT_KEYS = {
    "docs": ["sb", "site", "doc_key"], "keys": ["sb", "site", "rank"], "doc_count": ["sb", "site"],
    "postings": ["sb", "tb", "site", "term", "block", "doc_key"], "bounds": ["sb", "tb", "site", "term", "block"],
    "doc_freq": ["sb", "tb", "site", "term"],
}
LAYOUT = "site_buckets int, term_buckets int"


# ---- layout ------------------------------------------------------------------
def site_bucket(site: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(site), F.lit(buckets)).cast("int")


def term_bucket(site: Column, term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(site, term), F.lit(buckets)).cast("int")


def with_buckets(df: DataFrame, layout: tuple[int, int], term: bool = True) -> DataFrame:
    """``df`` (site, and term) with the folder columns of the layout."""
    out = df.withColumn("sb", site_bucket(F.col("site"), layout[0]))
    return out.withColumn("tb", term_bucket(F.col("site"), F.col("term"), layout[1])) if term else out


def with_block(df: DataFrame, doc_count: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``df`` (site, doc_key) with the block of each page: as many blocks a
    site as keep ``block_docs`` pages in one."""
    blocks = doc_count.select("site", F.ceil(F.col("n") / block_docs).alias("_blocks"))
    out = df.join(broadcast_if_small(blocks), "site")
    return out.withColumn("block", F.pmod(F.xxhash64("doc_key"), F.col("_blocks"))).drop("_blocks")


def read_layout(spark: SparkSession, root: str) -> tuple[int, int]:
    try:
        row = spark.read.schema(LAYOUT).parquet(os.path.join(root, "layout")).first()
    except AnalysisException as e:
        if not is_missing(e):
            raise
        row = None
    return (row["site_buckets"], row["term_buckets"]) if row else (SITE_BUCKETS, TERM_BUCKETS)


# ---- writing -----------------------------------------------------------------
def _put(df: DataFrame, root: str, name: str, layout: tuple[int, int], mode: str = "overwrite") -> DataFrame:
    df = with_buckets(df, layout, "tb" in SORT_KEYS[name]).select(*TABLES[name].fieldNames())
    # docs are left where they are: their rows are whole texts, and folders of sites are few
    return _write(df if name == "docs" else df.repartitionByRange(*SORT_KEYS[name]), root, name, mode)


def _write(df: DataFrame, root: str, name: str, mode: str) -> DataFrame:
    """Rows that lie in the tasks that are to write them."""
    keys, folders = SORT_KEYS[name], [c for c in ("sb", "tb") if c in SORT_KEYS[name]]
    (df.select(*TABLES[name].fieldNames()).sortWithinPartitions(*keys)
     .write.mode(mode).partitionBy(*folders).option("parquet.page.row.count.limit", str(PAGE_ROWS))
     .parquet(os.path.join(root, name)))
    return read_table(df.sparkSession, root, name)


def first_keys(docs: DataFrame, k: int) -> DataFrame:
    """(site, doc_key, rank): the ``k`` smallest keys of every site."""
    w = Window.partitionBy("site").orderBy("doc_key")
    return docs.select("site", "doc_key", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


def ranged(df: DataFrame, name: str, *aggs: Column) -> DataFrame:
    """``df`` summed up by the sort key of the table ``name``.  Ranges of the
    key never part a group, so the tasks that sum up also write: one exchange,
    and nothing is written in between.  A group is small: a block has some
    BLOCK_DOCS postings of a term, a term one bound a block."""
    keys = SORT_KEYS[name]
    return df.repartitionByRange(*keys).groupBy(*keys).agg(*aggs)


def bounds(postings: DataFrame) -> DataFrame:
    """(sb, tb, site, term, block, max_tf, n): what a block can add for a term
    at most."""
    return ranged(postings, "bounds", F.max("tf").alias("max_tf"), F.count("*").alias("n"))


def _finish(spark: SparkSession, root: str, docs: DataFrame, postings: DataFrame, doc_freq: DataFrame | None,
            doc_count: DataFrame, layout: tuple[int, int], mode: str) -> None:
    # range partitioning reads its input twice: what is computed is written first
    post = _put(materialize(postings, "index-postings"), root, "postings", layout, mode)
    least = _write(bounds(post), root, "bounds", mode)
    if doc_freq is None:      # each posting is counted in one block
        _write(ranged(least, "doc_freq", F.sum("n").alias("df")), root, "doc_freq", mode)
    else:
        _put(doc_freq, root, "doc_freq", layout, mode)
    _put(materialize(first_keys(docs, FIRST_KEYS), "index-keys"), root, "keys", layout, mode)
    spark.range(1).select(F.lit(layout[0]).alias("site_buckets"), F.lit(layout[1]).alias("term_buckets")) \
         .write.mode("overwrite").parquet(os.path.join(root, "layout"))


def write_index(index: dict, root: str, mode: str = "overwrite",
                layout: tuple[int, int] = (SITE_BUCKETS, TERM_BUCKETS)) -> None:
    """S2 for an index that is at hand (docs, postings, doc_freq, doc_count)."""
    docs = _put(index["docs"], root, "docs", layout, mode)
    n = _put(index["doc_count"], root, "doc_count", layout, mode)
    _finish(docs.sparkSession, root, docs, with_block(index["postings"], n), index["doc_freq"], n, layout, mode)


def build_and_store(docs: DataFrame, root: str, stopwords="nltk",
                    layout: tuple[int, int] = (SITE_BUCKETS, TERM_BUCKETS)) -> dict:
    """Build the index of ``docs`` into ``root``, each table computed once.

    docs are written first and read back, postings are computed from the
    written docs, and all else from the written postings and docs, so the text
    extraction and stemming run once and every later table starts from a
    materialised one (which also bounds what a lost executor can cost)."""
    from skein.operators import index as ix
    spark = docs.sparkSession
    docs_w = _put(docs, root, "docs", layout)
    n = _put(ix.doc_count(docs_w), root, "doc_count", layout)
    post = ix.term_freq(with_block(docs_w.select("site", "doc_key", "text"), n), stopwords, keys=("site", "doc_key", "block"))
    _finish(spark, root, docs_w, post, None, n, layout, "overwrite")
    return read_index(spark, root)


# ---- reading -----------------------------------------------------------------
def read_table(spark: SparkSession, root: str, name: str, site: str | None = None) -> DataFrame:
    """One index table with its folder columns; a missing table is an empty
    one (as a missing doc_freq file is an empty map).  ``site`` reads only the
    folder that the site's bucket names."""
    schema = TABLES[name]
    try:
        df = spark.read.schema(schema).parquet(os.path.join(root, name))
    except AnalysisException as e:
        if not is_missing(e):
            raise
        df = spark.createDataFrame([], schema)
    df = df.select(*schema.fieldNames())
    if site is None:
        return df
    bucket = site_bucket(F.lit(site), read_layout(spark, root)[0])
    return df.where((F.col("sb") == bucket) & (F.col("site") == site))


def read_index(spark: SparkSession, root: str, site: str | None = None) -> dict:
    """S3: the index of all sites, or of one site; ``layout`` names its
    numbers of buckets."""
    return {**{name: read_table(spark, root, name, site) for name in TABLES}, "layout": read_layout(spark, root)}
