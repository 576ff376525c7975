"""Explicit schemas for every table the engine reads or writes (no inference)."""

from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

PAGES = StructType([
    StructField("page_id", LongType()),
    StructField("url", StringType()),
    StructField("html", StringType()),
])

DOCUMENTS = StructType([
    StructField("doc_id", LongType()),
    StructField("text", StringType()),
    StructField("lang", StringType()),
    StructField("source", StringType()),
    StructField("n_chars", LongType()),
])

BENCHMARK = StructType([
    StructField("item_id", LongType()),
    StructField("text", StringType()),
])

CONVERSATIONS = StructType([
    StructField("conv_id", LongType()),
    StructField("turn", LongType()),
    StructField("role", StringType()),
    StructField("text", StringType()),
])

DOCS = StructType([
    StructField("site", StringType()),
    StructField("doc_key", StringType()),
    StructField("url", StringType()),
    StructField("text", StringType()),
])

POSTINGS = StructType([
    StructField("site", StringType()),
    StructField("doc_key", StringType()),
    StructField("term", StringType()),
    StructField("tf", LongType()),
])

DOC_FREQ = StructType([
    StructField("site", StringType()),
    StructField("term", StringType()),
    StructField("df", LongType()),
])

DOC_COUNT = StructType([
    StructField("site", StringType()),
    StructField("n", LongType()),
])

FRONTIER = StructType([
    StructField("site", StringType()),
    StructField("url", StringType()),
    StructField("round", IntegerType()),
])

SITES = StructType([
    StructField("pageid", StringType()),
    StructField("owner", StringType()),
    StructField("url", StringType()),
    StructField("status", StringType()),
])

SITE_KEYS = StructType([
    StructField("hash", StringType()),
    StructField("host", StringType()),
])
