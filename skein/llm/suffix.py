"""Exact removal of long repeated passages by a partitioned, sparse suffix sort.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere
else.  Sorting a suffix for every byte of the corpus would move hundreds of
times its size, so the suffixes that cannot matter are ruled out first, by
equality only (no chance is involved):

1. Each window of LENGTH bytes has an anchor: the place of the lowest hash
   among its grams of GRAM bytes.  Equal windows have equal anchors, so a
   window repeats only if its anchor's gram does.  An anchor owns a run of
   window starts; grams that occur once are dropped with all their windows.
2. Where the whole context of an anchor (all windows that it owns together)
   occurs twice, all its windows repeat and nothing is left to sort.
3. What remains are contexts at the rim of a repeat.  Each window start there
   is a suffix.  Its tokens are the hash of its anchor's gram and two 64-bit
   words that stand for its LENGTH bytes.  Splitters sampled by Spark
   range-partition the suffixes by these tokens (and, among equal ones, by
   place, so that one very frequent passage spreads over many buckets); each
   bucket is sorted by multikey quicksort and neighbours are compared; the
   first and last suffix of each bucket are then compared across the
   boundaries.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm import common

LENGTH = 400
GRAM_SHARE = 2           # a gram has LENGTH / GRAM_SHARE bytes
#: Bytes of (text, places) or (text, spans) that are sent to the tasks that read
#: the texts, as counted from the stored lists; more are joined by a shuffle.
MAX_BROADCAST = 128 << 20
BUCKET_ROWS = 1 << 19    # suffixes that one bucket sorts, about
BLOCK = 1 << 20          # windows of a text that are hashed at once
CHUNK = 1 << 18          # suffixes in one output batch
SMALL = 2048             # segments that are sorted at once

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_TAB = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:8], "little") for b in range(256)], np.uint64)
_HIGH = np.uint64(0xFFFFFFFF00000000)


@functools.lru_cache(maxsize=1)
def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.full(size, b, np.uint64)) for b in (_BASE, _BACK))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n at least."""
    return _power_tables(1 << max(17, (n - 1).bit_length()))


def _gram_hashes(a: np.ndarray, k: int) -> np.ndarray:
    """A hash for each gram of ``k`` bytes; only its order matters."""
    power, back = _powers(len(a))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TAB[a] * power[:len(a)])])
    h = (total[k:] - total[:-k]) * back[:len(a) - k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbours: of block prefixes and block suffixes."""
    n = len(x)
    pad = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    pad[:n] = x
    rows = pad.reshape(-1, w)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n - w + 1], head[w - 1:n])


def anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window) of each anchor of a text, which is
    read in blocks: a window's anchor depends on its own bytes only."""
    k = max(1, length // GRAM_SHARE)
    n = len(text) - length + 1          # windows
    place, first = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    data = np.frombuffer(text, np.uint8)
    for b in range(0, n, BLOCK):
        h = _gram_hashes(data[b:min(b + BLOCK, n) + length - 1], k)
        # the hash's upper half, then the place: the leftmost of equal hashes
        low = _sliding_min((h & _HIGH) | np.arange(len(h), dtype=np.uint64), length - k + 1)
        at = (low & ~_HIGH).astype(np.int64) + b
        new = np.flatnonzero(np.append(not len(place[-1]) or place[-1][-1] != at[0], at[1:] != at[:-1]))
        if len(new):
            place.append(at[new])
            first.append(new + b)
    at, first = np.concatenate(place), np.concatenate(first)
    return at, first, np.append(first[1:], n)[:len(first)] - 1


ANCHORS = "array<struct<gram:bigint,context:bigint,p:int,w:int>>"


def anchor_column(text: Column, length: int) -> Column:
    """Per text its anchors: hashes of gram and context, first window, number
    of further windows."""
    k = max(1, length // GRAM_SHARE)

    @F.arrow_udf(ANCHORS)
    def udf(texts: pa.Array) -> pa.Array:
        gram, ctx, p, w, cut = [], [], [], [], [0]
        for t in texts:
            t = t.as_buffer().to_pybytes()
            for a, s, e in zip(*(x.tolist() for x in anchors(t, length))):
                gram.append(xxhash.xxh3_64_intdigest(t[a:a + k]))
                ctx.append(xxhash.xxh3_64_intdigest(t[s:e + length], 1))
                p.append(s)
                w.append(e - s)
            cut.append(len(gram))
        as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64), pa.int64())
        rows = pa.StructArray.from_arrays([as_long(gram), as_long(ctx), pa.array(p, pa.int32()), pa.array(w, pa.int32())],
                                          names=["gram", "context", "p", "w"])
        return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), rows)
    return udf(common.utf8(text))


TOKENS = ["gram", "t1", "t2"]


def suffixes(rows: DataFrame, length: int) -> DataFrame:
    """The suffixes (gram, t1, t2, suffix) of ``rows`` (bytes, places), places
    being contexts (id, gram, p, w): three leading tokens, and suffix =
    id * 512 + distance."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, raw, ids, grams = xxhash.xxh3_128_digest, bytearray(), [], []

        def flush() -> pa.RecordBatch:
            tokens = np.frombuffer(bytes(raw), ">i8").astype(np.int64).reshape(-1, 2)
            cols = [np.concatenate(grams), np.ascontiguousarray(tokens[:, 0]), np.ascontiguousarray(tokens[:, 1]),
                    np.concatenate(ids)]
            raw.clear(), ids.clear(), grams.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=TOKENS + ["suffix"])
        for batch in batches:
            for text, places in zip(batch.column(0), batch.column(1)):
                text = text.as_buffer().to_pybytes()
                of = [places.values.field(i).to_numpy(zero_copy_only=False).tolist() for i in range(4)]
                for i, gram, p, w in zip(*of):
                    raw += b"".join([digest(text[j:j + length]) for j in range(p, p + w + 1)])
                    ids.append(np.arange(w + 1) + i * 512)
                    grams.append(np.full(w + 1, gram))
                    if len(raw) >= 16 * CHUNK:
                        yield flush()
        if raw:
            yield flush()
    return rows.mapInArrow(cut, "gram bigint, t1 bigint, t2 bigint, suffix bigint")


def multikey_quicksort(keys: list[np.ndarray]) -> np.ndarray:
    """The order of rows by ``keys``, the leading one first: three-way
    partition by one token; the middle part goes on with the next token."""
    out = np.empty(len(keys[0]), np.int64)
    stack = [(np.arange(len(out)), 0, 0)]
    while stack:
        rows, depth, at = stack.pop()
        if depth == len(keys) or len(rows) < 2:
            out[at:at + len(rows)] = rows
            continue
        if len(rows) <= SMALL:
            out[at:at + len(rows)] = rows[np.lexsort([k[rows] for k in reversed(keys[depth:])])]
            continue
        token = keys[depth][rows]
        pivot = np.sort(token[[0, len(rows) // 2, len(rows) - 1]])[1]
        less, same = token < pivot, token == pivot
        n, m = int(less.sum()), int(same.sum())
        stack.append((rows[less], depth, at))
        stack.append((rows[same], depth + 1, at + n))
        stack.append((rows[~(less | same)], depth, at + n + m))
    return out


BUCKET = "edge int, gram bigint, t1 bigint, t2 bigint, suffix bigint, lo int, hi int"


def _sort_bucket(batches):
    """Sort one bucket; give the repeated windows as (context id, lo, hi), and
    its first and last suffix (edge -1 and 1)."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    keys = [t[c].to_numpy() for c in TOKENS + ["suffix"]]
    order = multikey_quicksort(keys)
    *tokens, s = (k[order] for k in keys)
    eq = np.logical_and.reduce([k[1:] == k[:-1] for k in tokens])
    dup = np.append(eq, False) | np.append(False, eq)
    ids, off = np.divmod(s[dup], 512)
    by = np.argsort(ids, kind="stable")
    ids, off = ids[by], off[by]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
    lo = np.minimum.reduceat(off, first) if len(ids) else first
    hi = np.maximum.reduceat(off, first) if len(ids) else first
    n = len(first)
    cols = [np.concatenate([np.zeros(n, np.int32), [-1, 1]]).astype(np.int32),
            *[np.concatenate([np.zeros(n, np.int64), k[[0, -1]]]) for k in tokens],
            np.concatenate([ids[first], s[[0, -1]]]),
            np.concatenate([lo, [0, 0]]).astype(np.int32), np.concatenate([hi, [0, 0]]).astype(np.int32)]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols],
                                     names=["edge", *TOKENS, "suffix", "lo", "hi"])


def repeated_suffixes(rows: DataFrame, n: int) -> DataFrame:
    """(id, lo, hi): for each context with a window that is found elsewhere,
    the least and greatest distance of such a window.  ``n`` suffixes in
    ``rows`` make as many buckets as keep each of a size that a task can hold."""
    buckets = rows.repartitionByRange(1 + n // BUCKET_ROWS, *TOKENS, "suffix").mapInArrow(_sort_bucket, BUCKET)
    buckets = common.store(buckets, "suffix-buckets")
    inside = buckets.where("edge = 0").select(F.col("suffix").alias("id"), "lo", "hi")
    # two rows a bucket: equal tokens at both sides of a boundary
    edges = buckets.where("edge <> 0").select(*TOKENS, "suffix").distinct()
    both = edges.groupBy(*TOKENS).agg(F.collect_set("suffix").alias("s")).where(F.size("s") > 1)
    across = both.select(F.explode("s").alias("s")).select(
        F.floor(F.col("s") / 512).cast("long").alias("id"), F.pmod("s", F.lit(512)).cast("int").alias("lo"),
        F.pmod("s", F.lit(512)).cast("int").alias("hi"))
    return inside.union(across).groupBy("id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def fits(lists: DataFrame, column: str, each: int) -> bool:
    """Whether the stored (key, ``column``) rows, lists of ``each`` bytes an
    entry, may be sent to all tasks."""
    return (lists.agg(F.sum(F.size(column) * each + 48)).first()[0] or 0) <= MAX_BROADCAST


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, spans): per distinct text (key: MD5) that has any, the sorted
    maximal runs [from, to) of bytes to remove."""
    if not 2 <= length <= 512 * GRAM_SHARE // (GRAM_SHARE - 1):
        raise ValueError(length)
    texts = docs.select("text", text_key(F.col("text")).alias("key"))
    found = texts.select("key", F.explode(anchor_column(F.col("text"), length)).alias("a")).select("key", "a.*")
    found = common.store(found, "suffix-anchors")
    often = common.store(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "suffix-grams")
    found = common.store(common.semi_join(found, often, ["gram"], "n"), "suffix-often")
    # distinct contexts, combined before the shuffle: copies cost a row each task
    ctx = found.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("key", "p", "w")).alias("own"))
    ctx = common.store(ctx.withColumn("id", F.monotonically_increasing_id()), "suffix-contexts")
    whole = common.semi_join(found, ctx.where("n > 1"), ["gram", "context"], "n").select(
        "key", F.col("p").alias("s"), (F.col("p") + F.col("w") + length).alias("e"))
    # contexts that occur once, beside others of the same gram: sort their suffixes
    rim = ctx.groupBy("gram").agg(F.min("n").alias("least"), F.count("*").alias("m")).where("least = 1 and m > 1")
    rim = common.store(common.semi_join(ctx, common.store(rim, "suffix-rims"), ["gram"], "m"), "suffix-rim")
    places = rim.groupBy("own.key").agg(F.collect_list(F.struct("id", "gram", "own.p", "own.w")).alias("places"))
    places = common.store(places, "suffix-places")
    n = rim.agg(F.sum(F.col("own.w") + 1)).first()[0] or 0
    # a text that several rows hold is read once
    if fits(places, "places", 24):
        one = texts.join(F.broadcast(places), "key").dropDuplicates(["key"])
    else:
        one = texts.dropDuplicates(["key"]).join(places, "key")
    rows = suffixes(one.select(common.utf8(F.col("text")), "places"), length)
    part = repeated_suffixes(rows, n).join(rim.where("n = 1").select("id", "own"), "id").select(
        "own.key", (F.col("own.p") + F.col("lo")).alias("s"), (F.col("own.p") + F.col("hi") + length).alias("e"))
    every = whole.union(part).groupBy("key", "s").agg(F.max("e").alias("e"))
    per = every.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))
    return common.store(per, "suffix-spans")


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(common.utf8(text)))


def cut(text: bytes, spans) -> tuple[bytes, int, int]:
    """(rest, bytes removed, maximal runs) of a text and its sorted spans."""
    keep, runs, removed, end = [], 0, 0, 0
    for x in spans or ():
        s, e = x["s"], x["e"]
        if s > end or not runs:
            keep.append(text[end:s])
            runs += 1
            removed += e - s
            end = e
        elif e > end:
            removed += e - end
            end = e
    keep.append(text[end:])
    return b"".join(keep), removed, runs


def remove_repeats(docs: DataFrame, length: int = LENGTH, carry: list[str] | None = None) -> DataFrame:
    """(__row, kept, n_bytes, n_removed, n_spans) for every row of ``docs``;
    ``kept`` is the rest of the text as bytes (a cut can split a character).

    A null text is empty.  Texts shorter than ``length`` bytes stay whole.
    Rows that repeat a text are occurrences of their own, so a repeated text
    of ``length`` bytes or more goes in all of them.  An empty table gives an
    empty result.  Very long texts are hashed in blocks and cut whole.
    """
    common.prepare(docs.sparkSession)
    spans = repeated_spans(docs, length)
    rows = docs.select(common.pack(docs.select(carry or docs.columns)), common.utf8(F.col("text")).alias("bytes"),
                       text_key(F.col("text")).alias("key"))
    rows = rows.join(F.broadcast(spans), "key", "left") if fits(spans, "spans", 16) else common.left_join(rows, spans, "key")

    @F.arrow_udf("struct<kept:binary,n_removed:bigint,n_spans:bigint>")
    def udf(texts: pa.Array, lists: pa.Array) -> pa.Array:
        got = [cut(t.as_buffer().to_pybytes(), s) for t, s in zip(texts, lists.to_pylist())]
        cols = list(zip(*got)) if got else [[], [], []]
        return pa.StructArray.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()),
                                           pa.array(cols[2], pa.int64())], names=["kept", "n_removed", "n_spans"])
    out = rows.select(common.ROW, "bytes", F.when(F.col("spans").isNotNull(), udf("bytes", "spans")).alias("c"))
    zero = F.lit(0).cast("long")
    return out.select(common.ROW, F.coalesce("c.kept", "bytes").alias("kept"), F.octet_length("bytes").cast("long").alias("n_bytes"),
                      F.coalesce("c.n_removed", zero).alias("n_removed"), F.coalesce("c.n_spans", zero).alias("n_spans"))
