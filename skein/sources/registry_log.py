"""S9 as a change log: registry events are appended, the tables are a fold.

An event is one row (event_id, seq, kind, pageid, owner, url, status, host):

  register  pageid, owner, url, status   R2: the earliest since the pair was deleted counts
  delete    pageid, owner                R6
  status    pageid, status               R3: on every owner's row registered before
  crawling  pageid                       R4: marks the status that holds, once
  site_key  pageid, host                 R1: the latest counts

``seq`` orders events; ``event_id`` names one, so an event that is delivered
twice, in whatever batch, counts once.  A batch is a folder of its own, made
visible by a marker that is written last: a save that fails half-way is not
seen, and saving a batch again replaces it.

Every rule of the fold is a grouped minimum or maximum, so it is combined
before it is shuffled, and a site with a third of all events is no single task.
``compact`` replaces the batches so far by the few events that still matter:
events of a later batch must not have a smaller ``seq`` than these.  The ids
of compacted events are kept, so a late repeat of one is still known.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.registry import crawling_status
from skein.sources.tables import is_missing

EVENTS = ("event_id string, seq bigint, kind string, pageid string, owner string, url string, status string, "
          "host string")
COMMITS = "batch bigint, base boolean"
KINDS = ("register", "delete", "status", "crawling", "site_key")


def events(rows: DataFrame, kind: str, event_id: Column, seq: Column, **columns: Column) -> DataFrame:
    """``rows`` as events of one ``kind``; columns it does not have are null."""
    if kind not in KINDS:
        raise ValueError(kind)
    given = {"event_id": event_id.cast("string"), "seq": seq.cast("long"), "kind": F.lit(kind), **columns}
    names = [f.split()[0] for f in EVENTS.split(", ")]
    return rows.select(*[given.get(n, F.lit(None).cast("string")).alias(n) for n in names])


# ---- storage -----------------------------------------------------------------
def _path(root: str, table: str, batch: int, base: bool) -> str:
    return os.path.join(root, table, f"{'base' if base else 'batch'}={batch}")


def _commit(spark: SparkSession, root: str, batch: int, base: bool) -> None:
    row = spark.range(1).select(F.lit(batch).cast("long").alias("batch"), F.lit(base).alias("base"))
    row.write.mode("overwrite").parquet(os.path.join(root, "commits", f"{'base' if base else 'batch'}-{batch}"))


def commits(spark: SparkSession, root: str) -> list[tuple[int, bool]]:
    """(batch, base) of every marker: one row a batch."""
    try:
        rows = spark.read.schema(COMMITS).option("recursiveFileLookup", True).parquet(os.path.join(root, "commits")).collect()
    except AnalysisException as e:
        if not is_missing(e):
            raise
        rows = []
    return sorted({(r["batch"], r["base"]) for r in rows})


def append(new: DataFrame, root: str, batch: int) -> None:
    """Save events as ``batch``; saving it again replaces it."""
    new.select(*[f.split()[0] for f in EVENTS.split(", ")]).write.mode("overwrite").parquet(_path(root, "events", batch, False))
    _commit(new.sparkSession, root, batch, False)


def read(spark: SparkSession, root: str) -> DataFrame:
    """The events that count: the newest base and the batches after it, each
    event once."""
    found = commits(spark, root)
    base = max((b for b, is_base in found if is_base), default=None)
    later = [b for b, is_base in found if not is_base and (base is None or b > base)]
    load = lambda paths: spark.read.schema(EVENTS).parquet(*paths) if paths else spark.createDataFrame([], EVENTS)
    new = load([_path(root, "events", b, False) for b in later])
    # of an id that comes twice the lesser seq, then the lesser row, counts
    rest = [c for c in new.columns if c != "event_id"]
    new = new.groupBy("event_id").agg(F.min(F.struct(*rest)).alias("e")).select("event_id", "e.*")
    if base is None:
        return new
    known = spark.read.schema("event_id string").parquet(_path(root, "ids", base, True))
    return load([_path(root, "events", base, True)]).unionByName(new.join(known, "event_id", "left_anti"))


# ---- fold --------------------------------------------------------------------
def _kind(log: DataFrame, kind: str) -> DataFrame:
    return log.where(F.col("kind") == kind)


def surviving(log: DataFrame) -> dict[str, DataFrame]:
    """For each kind the events that the tables rest on."""
    deleted = _kind(log, "delete").groupBy("pageid", "owner").agg(F.max("seq").alias("gone"))
    since = _kind(log, "register").join(deleted, ["pageid", "owner"], "left").where(
        F.col("gone").isNull() | (F.col("seq") > F.col("gone")))
    whole = F.struct("seq", "event_id", "url", "status")
    first = since.groupBy("pageid", "owner").agg(F.min(whole).alias("e")).select("pageid", "owner", "e.*")
    last = lambda kind, column: _kind(log, kind).where(
        F.col(column).isNotNull() | (F.col("kind") != "status")).groupBy("pageid").agg(
        F.max(F.struct("seq", "event_id", column)).alias("e")).select("pageid", "e.*")
    return {"register": first, "status": last("status", "status"), "crawling": last("crawling", "owner"),
            "site_key": last("site_key", "host")}


def fold(log: DataFrame) -> dict[str, DataFrame]:
    """``sites`` (pageid, owner, url, status) and ``site_keys`` (hash, host)."""
    kept = surviving(log)
    told = kept["status"].select("pageid", F.col("seq").alias("told"), F.col("status").alias("new"))
    marked = kept["crawling"].select("pageid", F.col("seq").alias("marked"))
    s = kept["register"].join(told, "pageid", "left").join(marked, "pageid", "left")
    after = F.col("told") > F.col("seq")            # null where there is none
    status = F.when(after, F.col("new")).otherwise(F.col("status"))
    since = F.when(after, F.col("told")).otherwise(F.col("seq"))
    status = F.when(F.col("marked") > since, crawling_status(status)).otherwise(status)
    return {"sites": s.select("pageid", "owner", "url", status.alias("status")),
            "site_keys": kept["site_key"].select(F.col("pageid").alias("hash"), "host")}


def load(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables as of the last batch; empty ones where there is no log."""
    return fold(read(spark, root))


def compact(spark: SparkSession, root: str) -> None:
    """Replace what is committed so far by the events that still count.  The
    base becomes visible with its marker; until then, and if this fails, the
    batches are read as before."""
    found = commits(spark, root)
    base = max((b for b, is_base in found if is_base), default=None)
    upto = max((b for b, is_base in found if not is_base), default=None)
    if upto is None or upto == base:
        return
    log = read(spark, root)
    names = [f.split()[0] for f in EVENTS.split(", ")]
    rows = None
    for kind, df in surviving(log).items():
        part = df.withColumn("kind", F.lit(kind))
        part = part.select(*[F.col(n) if n in part.columns else F.lit(None).cast("string").alias(n) for n in names])
        rows = part if rows is None else rows.unionByName(part)
    ids = log.select("event_id")
    if base is not None:
        ids = ids.union(spark.read.schema("event_id string").parquet(_path(root, "ids", base, True)))
    rows.write.mode("overwrite").parquet(_path(root, "events", upto, True))
    ids.distinct().write.mode("overwrite").parquet(_path(root, "ids", upto, True))
    _commit(spark, root, upto, True)
