"""The page corpus stored for crawl rounds (J5): one row a URL, in buckets of
the URL's hash.

A round's batch is then joined inside the buckets: Spark moves the batch, not
the pages, however large the batch is.  The table is kept in the session's
catalog (bucketing is a property of tables), its files below the shared
folder.  Of several pages of one URL the one with the least HTML counts; only
such pages are compared, and found by their URLs alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.broadcast import broadcast_if_small
from skein.session import scratch_path

BUCKETS = 16


def one_per_url(pages: DataFrame) -> DataFrame:
    """(url, html): one row a URL.  HTML takes part in an aggregation only
    where a URL has several pages."""
    several = pages.groupBy("url").count().where("count > 1").select("url")
    several = broadcast_if_small(several)
    pages = pages.select("url", "html").where("url is not null")
    best = pages.join(several, "url", "left_semi").groupBy("url").agg(F.min("html").alias("html"))
    return pages.join(several, "url", "left_anti").unionByName(best)


def store_corpus(pages: DataFrame, path: str | None = None, buckets: int = BUCKETS, name: str | None = None) -> DataFrame:
    """Write ``pages`` (url, html) as a bucketed table and return it."""
    spark = pages.sparkSession
    name = name or f"corpus_{uuid.uuid4().hex[:12]}"
    path = path or scratch_path(spark, "corpus")
    # dealt by the bucket hash beforehand: a bucket is one file
    rows = one_per_url(pages).repartition(buckets, "url").sortWithinPartitions("url")
    (rows.write.format("parquet").mode("overwrite").bucketBy(buckets, "url").sortBy("url")
     .option("path", path).saveAsTable(name))
    return spark.table(name)


def open_corpus(spark: SparkSession, path: str, buckets: int = BUCKETS, name: str | None = None) -> DataFrame:
    """A stored corpus in a new session."""
    name = name or f"corpus_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE TABLE {name} (url STRING, html STRING) USING parquet OPTIONS (path '{path}') "
              f"CLUSTERED BY (url) SORTED BY (url) INTO {buckets} BUCKETS")
    return spark.table(name)
