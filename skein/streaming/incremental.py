"""Incremental index maintenance with Structured Streaming.

Fetched pages (or documents) arrive as Parquet files in a directory.  A
streaming query analyses each micro-batch and writes, below
``<table>/version=<batch_id>``,

  docs       (site, doc_key, url, text)     the batch's pages, each once
  postings   (site, doc_key, term, tf)
  df_delta   (site, term, df)               +1 for a term a page now has,
                                            -1 for one its last version had
  n_delta    (site, n)                      pages that are new to a site
  commits    (version)                      written last: the batch counts

so document frequency and page counts are sums of signed deltas (A3) and are
never recounted from postings.  The delta of a batch rests on committed
versions before it alone: a batch that is replayed after a failure writes the
same rows over the same folders, and a half-written one is not seen.  The
pages replaced are looked up by their keys (no text is read), and their old
postings by version, which is a folder.

``compact`` writes what holds as of the last commit as a base; from then on
the base and the versions after it are read.

Intake per trigger is bounded by ``maxFilesPerTrigger`` (T2) and
``trigger(availableNow=True)`` drains what is there and stops.  Counts of
fetched, failed and all rows (T3) are observed while the batch is read, once,
and stored by a listener under the batch's version, so a replay replaces them.

The checkpoint lies below the output unless one is named, so a later run goes
on where the last one stopped and its versions follow the earlier ones.  A
page that comes twice in one batch counts once: the greatest text stays.  A
row without content (a failed fetch) is counted and not indexed.
"""

from __future__ import annotations

import os
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from skein import schemas
from skein.operators import index as ix
from skein.operators.broadcast import broadcast_if_small
from skein.session import materialize
from skein.sources.tables import is_missing

SOURCES = {"pages": schemas.PAGES, "documents": schemas.DOCUMENTS}
CONTENT = {"pages": "html", "documents": "text"}
TABLES = {"docs": schemas.DOCS, "postings": schemas.POSTINGS, "df_delta": schemas.DOC_FREQ, "n_delta": schemas.DOC_COUNT}
COUNTS = "fetched bigint, failed bigint, total bigint, version bigint"
KEYS = ["site", "doc_key"]


def _to_docs(batch: DataFrame, kind: str, site: str | None) -> DataFrame:
    if kind == "pages":
        return ix.docs_from_pages(batch)
    return ix.docs_from_documents(batch, site=site)


def _once(docs: DataFrame) -> DataFrame:
    """One row a page, the one with the greatest text (then url)."""
    best = docs.groupBy("site", "doc_key").agg(F.max(F.struct("text", "url")).alias("b"))
    return best.select("site", "doc_key", "b.url", "b.text")


# ---- what is committed -------------------------------------------------------
def _markers(spark: SparkSession, root: str, table: str) -> list[int]:
    """Versions with a marker in ``table``, a row each."""
    try:
        rows = spark.read.schema("at bigint").option("recursiveFileLookup", True).parquet(os.path.join(root, table)).collect()
    except AnalysisException as e:
        if not is_missing(e):
            raise
        rows = []
    return sorted({r["at"] for r in rows})


def _mark(spark: SparkSession, root: str, table: str, at: int) -> None:
    spark.range(1).select(F.lit(at).cast("long").alias("at")).write.mode("overwrite").parquet(
        os.path.join(root, table, f"version={at}"))


class Versions:
    """The committed versions below ``before`` (all, if None) of an output."""

    def __init__(self, spark: SparkSession, root: str, before: int | None = None):
        fits = lambda v: before is None or v < before
        self.spark, self.root = spark, root
        self.base = max(filter(fits, _markers(spark, root, "bases")), default=None)
        found = [v for v in _markers(spark, root, "commits") if fits(v)]
        self.last = max(found, default=None)
        self.later = [v for v in found if self.base is None or v > self.base]

    def table(self, name: str) -> DataFrame:
        """Rows of ``name`` with the version they were written by."""
        schema = StructType([*TABLES[name].fields, StructField("version", LongType())])
        rows = self.spark.createDataFrame([], schema)
        if self.later:
            # folders of one table: a filter on version reads those it names
            v = self.spark.read.schema(schema).option("basePath", os.path.join(self.root, name)).parquet(
                *[os.path.join(self.root, name, f"version={v}") for v in self.later])
            rows = v.select(*schema.fieldNames())
        if self.base is not None:
            b = self.spark.read.schema(schema).parquet(os.path.join(self.root, "base", name, f"upto={self.base}"))
            rows = b.select(*schema.fieldNames()).unionByName(rows) if self.later else b.select(*schema.fieldNames())
        return rows

    def heads(self, only: DataFrame | None = None) -> DataFrame:
        """(site, doc_key, version): the newest version of each page, or of
        those in ``only``.  Reads key columns only."""
        keys = self.table("docs").select(*KEYS, "version")
        if only is not None:
            keys = keys.join(broadcast_if_small(only.select(*KEYS)), KEYS, "left_semi")
        return keys.groupBy(*KEYS).agg(F.max("version").alias("version"))

    def superseded(self) -> DataFrame:
        """(site, doc_key, version) that a newer version replaces."""
        return ix.superseded(self.table("docs"))


def changes(versions: Versions, docs: DataFrame, postings: DataFrame) -> dict[str, DataFrame]:
    """A3: the signed deltas that ``docs`` and ``postings`` of a batch make to
    what ``versions`` hold."""
    replaced = materialize(versions.heads(docs), "replaced")
    gone = versions.table("postings").join(broadcast_if_small(replaced), [*KEYS, "version"], "left_semi")
    n = docs.select("site", F.lit(1).alias("n")).unionByName(replaced.select("site", F.lit(-1).alias("n")))
    return {"df_delta": ix.doc_freq_delta(postings, gone).where("df <> 0"),
            "n_delta": n.groupBy("site").agg(F.sum("n").alias("n")).where("n <> 0")}


# ---- the stream ----------------------------------------------------------------
def write_batch(batch: DataFrame, version: int, out_root: str, kind: str, site: str | None, stopwords) -> None:
    """One micro-batch: ``batch`` is read once, for docs; all else starts from
    what was written."""
    spark = batch.sparkSession

    def put(name: str, df: DataFrame) -> DataFrame:
        path = os.path.join(out_root, name, f"version={version}")
        df.select(*TABLES[name].fieldNames()).write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    docs = put("docs", _once(_to_docs(batch.where(F.col(CONTENT[kind]).isNotNull()), kind, site)))
    postings = put("postings", ix.term_freq(docs, stopwords))
    for name, df in changes(Versions(spark, out_root, before=version), docs, postings).items():
        put(name, df)
    _mark(spark, out_root, "commits", version)


class ProgressListener(StreamingQueryListener):
    """Stores the observed counts of each batch of the stream ``name``."""

    def __init__(self, spark: SparkSession, out_root: str, name: str):
        self.spark, self.root, self.name, self.seen = spark, out_root, name, set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = p.observedMetrics.get(self.name)
        if row is not None and row["total"]:
            self.store(p.batchId, row["fetched"], row["failed"], row["total"])

    def store(self, version: int, fetched: int, failed: int, total: int) -> None:
        one = self.spark.range(1).select(*[F.lit(n).cast("long").alias(c) for c, n in
                                           (("fetched", fetched), ("failed", failed), ("total", total))])
        one.write.mode("overwrite").parquet(os.path.join(self.root, "progress", f"version={version}"))
        self.seen.add(version)


def stored_progress(spark: SparkSession, out_root: str) -> DataFrame:
    """(version, fetched, failed, total): a row for each batch so far."""
    try:
        df = spark.read.schema(COUNTS).parquet(os.path.join(out_root, "progress"))
    except AnalysisException as e:
        if not is_missing(e):
            raise
        df = spark.createDataFrame([], COUNTS)
    return df.select("version", "fetched", "failed", "total")


def start_index_stream(spark: SparkSession, source_dir: str, out_root: str,
                       kind: str = "pages", site: str | None = None,
                       max_files_per_trigger: int = 1, stopwords="nltk",
                       checkpoint: str | None = None) -> tuple[StreamingQuery, ProgressListener]:
    """T1 + T2 + T3: start the stream; returns the running query and the
    listener that stores its counts (remove it when the query has ended)."""
    name = "progress_" + os.path.basename(out_root.rstrip("/")).replace("-", "_")
    there = F.col(CONTENT[kind]).isNotNull()
    stream = (spark.readStream.schema(SOURCES[kind])
              .option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir)
              .observe(name, F.count_if(there).alias("fetched"), F.count_if(~there).alias("failed"),
                       F.count(F.lit(1)).alias("total")))
    listener = ProgressListener(spark, out_root, name)
    spark.streams.addListener(listener)
    ckpt = checkpoint or os.path.join(out_root, "_checkpoint")
    query = (stream.writeStream
             .foreachBatch(lambda batch, i: write_batch(batch, i, out_root, kind, site, stopwords))
             .option("checkpointLocation", ckpt)
             .trigger(availableNow=True).start())
    return query, listener


def run_index_stream(spark: SparkSession, source_dir: str, out_root: str, wait: float = 60.0, **kw) -> list[dict]:
    """Start, drain and stop; returns the counts of each batch of this run.
    Events reach the listener after the batch: they are waited for, ``wait``
    seconds at most, and what is missing then is taken from the query."""
    query, listener = start_index_stream(spark, source_dir, out_root, **kw)
    try:
        query.awaitTermination()
        mine = {p["batchId"]: row for p in query.recentProgress
                if (row := p["observedMetrics"].get(listener.name)) is not None and row["total"]}
        end = time.monotonic() + wait
        while not set(mine) <= listener.seen and time.monotonic() < end:
            time.sleep(0.1)
        for version in set(mine) - listener.seen:
            listener.store(version, *[mine[version][c] for c in ("fetched", "failed", "total")])
    finally:
        spark.streams.removeListener(listener)
    rows = stored_progress(spark, out_root).where(F.col("version").isin(sorted(mine))).orderBy("version").collect()
    return [{c: r[c] for c in ("fetched", "failed", "total")} for r in rows]


# ---- reading -----------------------------------------------------------------
def current_index(spark: SparkSession, out_root: str) -> dict:
    """The index as of the last commit: newest version of each page, its
    postings, and DF / N as sums of deltas."""
    v = Versions(spark, out_root)
    old = materialize(v.superseded(), "superseded")       # asked for by every table
    live = lambda name: ix.without(v.table(name), old).drop("version")
    total = lambda name, keys, c: v.table(name).groupBy(*keys).agg(F.sum(c).alias(c)).where(F.col(c) > 0)
    return {"docs": live("docs"), "postings": live("postings"),
            "doc_freq": total("df_delta", ["site", "term"], "df"), "doc_count": total("n_delta", ["site"], "n")}


def compact(spark: SparkSession, out_root: str) -> None:
    """Write the index of the last commit as a base: superseded versions and
    single deltas are no longer read.  The base counts once its marker is
    written; a failure before that changes nothing."""
    v = Versions(spark, out_root)
    if not v.later:
        return
    old = materialize(v.superseded(), "superseded")
    tables = {name: ix.without(v.table(name), old) for name in ("docs", "postings")}
    for name, keys, c in (("df_delta", ["site", "term"], "df"), ("n_delta", ["site"], "n")):
        sums = v.table(name).groupBy(*keys).agg(F.sum(c).alias(c)).where(F.col(c) != 0)
        tables[name] = sums.withColumn("version", F.lit(v.last).cast("long"))
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(os.path.join(out_root, "base", name, f"upto={v.last}"))
    _mark(spark, out_root, "bases", v.last)
