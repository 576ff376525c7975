"""Helpers shared by the operators: row packing, tables in the shared folder,
Arrow batch bounds, connected components."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import scratch_path

ROW = "__row"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BATCH_BYTES = 16 << 20
SMALL_BATCH = 4 << 20         # of jobs that keep much beside a batch
#: Allocator settings of the Python workers.
LEAN = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": str(1 << 20)}


def prepare(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> None:
    """For jobs that run Python: bound the Arrow batches by bytes, so that very
    long texts do not pile up in one (each holds one row at least), tell the
    workers where this package lies, and let them give freed memory back: a
    worker outlives its tasks, and what one job took is missing to the next."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))
    for name, value in LEAN.items():
        env.setdefault(name, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: lineage is cut
    there, and a lost executor costs no more than the tasks it was running."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pack(df: DataFrame) -> Column:
    """The whole input row as one struct, so that columns an operator adds can
    never clash with names the input already has."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW)


def unpack(df: DataFrame) -> DataFrame:
    return df.select(f"{ROW}.*")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def utf8(c: Column) -> Column:
    """Text as UTF-8 bytes; null as no bytes."""
    return F.coalesce(c, F.lit("")).cast("binary")


def semi_join(rows: DataFrame, keys: DataFrame, on: list[str], count: str, share: int = 512) -> DataFrame:
    """The ``rows`` whose ``on`` are among the stored ``keys``; ``count`` says
    how many rows hold a key.  Keys of more than 1 / ``share`` of these rows
    are fewer than ``share``: they are sent to the rows, which stay where they
    are; the other keys meet their rows by a shuffle, in which none is hot."""
    total = keys.agg(F.sum(count)).first()[0] or 0
    hot = store(keys.where(F.col(count) * share > F.lit(total)).select(*on), "hot-keys")
    if hot.isEmpty():
        return rows.join(keys.select(*on), on, "left_semi")
    hot = F.broadcast(hot)
    rest = rows.join(hot, on, "left_anti").join(keys.select(*on).join(hot, on, "left_anti"), on, "left_semi")
    return rows.join(hot, on, "left_semi").unionByName(rest)


def left_join(rows: DataFrame, side: DataFrame, on: str, share: int = 512, salts: int = 64) -> DataFrame:
    """``rows`` left-joined with ``side`` (one row a key) by a shuffle in which
    the rows of a hot key go to ``salts`` tasks: its row of ``side`` is
    repeated so often.  Hot keys hold more than 1 / ``share`` of the rows, so
    they are fewer than ``share``."""
    counts = rows.groupBy(on).agg(F.count("*").alias("n"))
    counts = store(counts.where(F.col("n") > 1), "key-counts")
    total = rows.count()
    hot = store(counts.where(F.col("n") * share > F.lit(total)).select(on, F.lit(salts).alias("__salts")), "hot-keys")
    spread = lambda df: df.join(F.broadcast(hot), on, "left")
    left = spread(rows).withColumn("__salt", F.when(F.col("__salts").isNull(), 0).otherwise(
        F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))).drop("__salts")
    right = spread(side).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return left.join(right, [on, "__salt"], "left").drop("__salt")


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of the undirected ``edges`` (a, b), as rows
    (node, component) with the smallest node reachable.

    Rounds of large-star and small-star: each hangs neighbours on the smallest
    node seen, so that the paths shorten geometrically.  Every step is a
    grouped minimum (combined before the shuffle, so a node with millions of
    neighbours is no single task) and a join on the node; each round is
    written to the shared folder.  Ends when a round changes nothing; until
    then every round hangs some node on a smaller one, so the rounds end (in a
    number that grows as the logarithm of the nodes).
    """
    spark = edges.sparkSession
    cur = store(edges.where("a <> b").select(F.greatest("a", "b").alias("u"),
                                             F.least("a", "b").alias("v")).distinct(), f"{name}-cc")
    state = None
    while True:
        both = cur.union(cur.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        large = store(large.distinct(), f"{name}-cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v")))
                 .where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        cur = store(small.distinct(), f"{name}-cc")
        seen = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
