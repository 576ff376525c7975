"""Shards by jump consistent hashing.

A row's shard follows from its key and the number of shards alone, with no
table of a ring: the key seeds a random sequence, and the sequence jumps from
one shard count at which the key moves to the next.  The last such count
below the number of shards is the key's shard.  With shards appended, a key
either stays or goes to one of the new ones, and about 1 / n of all keys go
to the n-th.

Slots number the rows of a shard in key order without ranking a shard in one
task: narrow rows are range-partitioned by (shard, key), numbered within their
partition, and shifted by the rows of the partitions before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from skein.llm import common

LAW = "key"
OVERHEAD = 8              # bytes of a row beside its text
_STEP = np.uint64(2862933555777941757)       # multiplier of the published generator


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard in 0 .. ``shards`` - 1 of each unsigned 64-bit key."""
    if shards < 1:
        raise ValueError(shards)
    out = np.zeros(len(keys), np.int64)
    live, key, at = np.arange(len(keys)), keys.astype(np.uint64), np.zeros(len(keys), np.int64)
    while len(live):
        out[live] = at
        key = key * _STEP + np.uint64(1)
        at = ((at + 1) * (float(1 << 31) / ((key >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        more = at < shards
        live, key, at = live[more], key[more], at[more]
    return out


def key_bits(docs: DataFrame, key: str) -> Column:
    """A key as 64 bits: whole numbers as they are, others by their hash; null
    keys are alike."""
    whole = isinstance(docs.schema[key].dataType, IntegralType)
    c = F.col(f"`{key}`")
    return F.coalesce(c.cast("long") if whole else F.xxhash64(c), F.lit(0).cast("long"))


def shard_column(bits: Column, shards: int) -> Column:
    @F.arrow_udf("int")
    def udf(keys: pa.Array) -> pa.Array:
        return pa.array(jump(keys.to_numpy(zero_copy_only=False).view(np.uint64), shards).astype(np.int32))
    return udf(bits)


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``: 0, 1, ... within each ``group`` by ``order``;
    equal rows are told apart by their place in the input, which is stored
    first.  A partition holds a range of (group, order, place), so one group
    or one frequent key spreads over many; only a count for each partition and
    group, at most partitions + groups rows, is ranked and sent to all tasks."""
    rows = common.store(rows.withColumn("__place", F.monotonically_increasing_id()), "numbered-rows")
    by = [group, *order, "__place"]
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    rows = rows.drop("__place").withColumn("__at", F.monotonically_increasing_id())
    rows = common.store(rows.withColumn("__part", F.shiftright("__at", 33)), "numbered-sorted")
    parts = rows.groupBy("__part", group).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    parts = common.store(parts, "numbered-parts")
    out = rows.join(F.broadcast(parts), ["__part", group])
    return out.withColumn(name, F.col("__before") + F.col("__at") - F.col("__first")).drop(
        "__part", "__at", "__first", "__before")


def assign(docs: DataFrame, shards: int, key: str = "doc_id", carry: list[str] | None = None,
           more: int = 1) -> DataFrame:
    """(__row, key, size, text_crc32, shard, slot, grown_shard) for every row
    of ``docs``: its shard of ``shards``, its place there in the order of
    (key, size, text_crc32), and its shard with ``more`` shards appended.

    Rows of one key go together: doc_id keeps rows apart, any other column
    (the text's digest, say) keeps its groups whole.  A null key counts as one
    key, a null text as no bytes.  Repeated rows get slots of their own, very
    long texts are only measured, and an empty table gives an empty result.
    """
    common.prepare(docs.sparkSession)
    text = common.utf8(F.col("text"))
    rows = docs.select(common.pack(docs.select(carry or docs.columns)), F.col(f"`{key}`").alias("key"),
                       (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), key_bits(docs, key).alias("bits"))
    rows = rows.withColumns({"shard": shard_column(F.col("bits"), shards),
                             "grown_shard": shard_column(F.col("bits"), shards + more)}).drop("bits")
    return numbered(rows, "shard", ["key", "size", "text_crc32"], "slot")


def write(docs: DataFrame, path: str, shards: int, key: str = "doc_id", file_rows: int = 100_000) -> None:
    """Write the rows of ``docs`` as ``path``/__shard=<n>/*.parquet with their
    slot (``__slot``), in files of runs of slots of at most ``file_rows`` rows:
    a shard is written by as many tasks as hold its rows."""
    a = assign(docs, shards, key)
    rows = a.select(F.col("shard").alias("__shard"), F.col("slot").alias("__slot"), f"{common.ROW}.*")
    by = ["__shard", "__slot"]
    (rows.repartitionByRange(*by).sortWithinPartitions(*by).write.partitionBy("__shard")
     .option("maxRecordsPerFile", file_rows).parquet(path))


def moves(assigned: DataFrame) -> DataFrame:
    """(shard, grown_shard, n, size): what appending shards moves, and where."""
    return (assigned.where("shard <> grown_shard").groupBy("shard", "grown_shard")
            .agg(F.count("*").alias("n"), F.sum("size").alias("size")))
