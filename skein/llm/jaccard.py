"""Exact Jaccard join of documents on word shingles, in a metric space.

The Jaccard distance d = 1 - J is a metric, so with pivots known the triangle
inequality bounds every other distance.  Pivots drawn from the whole corpus do
not help, though: almost all texts are at a distance of about 1 from each
other.  So the Voronoi regions are seeded where documents can be near at all:

1. Equal sets are one point (its weight: the number of its documents).
2. A pair at the wanted similarity shares a shingle among the few first ones
   of both sets, in any fixed order of all shingles (long ones first, as they
   are rare; those known as common from a sample last; the order affects speed
   only).  Each such shingle is a region, cut further by windows on the set
   size that replicate points at a boundary into both neighbours.  The first
   shingle that a pair shares stands so early in both sets that the rest can
   make up the overlap: pairs for which a region's shingle cannot be that one
   are left to another region.
3. In each region the heaviest point is the pivot.  All others are measured
   against it; those in its ball are linked to it and so with each other: they
   form one component and need no comparison among themselves.
4. Regions that still hold several components are joined again without their
   pivot.  Small ones compare the remaining pairs of different components.
   Large ones draw about sqrt(m) pivots, every point goes to its nearest and,
   by the triangle inequality, to each other whose distance is within twice
   the radius of that; the new regions recur.  A region that this does not
   shrink (all distances alike) is compared in blocks, as is one of a block.

Links are counted on whole shingle sets.  Before that most pairs are ruled
out by bitmaps: each shingle of a set flips one bit of its map, so two sets
differ in at least as many shingles as their maps differ in bits.  The number
of these bits is a metric, too: it is the distance of step 4, which so needs
no texts.  The result is the exact set of components of the link graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm import common

SHINGLE, PERCENT = 5, 80          # defaults of the near-duplicate stage
SAMPLE = 2000                     # documents the order of shingles is learnt from, about
COMMON = 50_000                   # shingles that can be called common
SEEN = 3                          # documents of the sample that hold a common shingle
SMALL = 64                        # points of a region whose pairs are compared at once
BLOCK = 8                         # a block of a large region has about this many times the points of a small one
CHUNK = 4096                      # points that are held against the pivots of a region at once, about
MAX_BROADCAST = 1_000_000         # ids that are sent to the tasks that read texts
MAX_TEXTS = 16 << 20              # bytes of texts that are sent to the tasks that hold the other side
MAX_CACHE = 100_000               # words a worker remembers
MAX_SETS = 1 << 21                # shingles of sets a worker remembers
LEAST_BITS = 64                   # of a set's bitmap; larger ones have a power of two
COMPARE = 1 << 22                 # bytes of bitmaps that are compared at once, about
BUCKET = 4096                     # rows of small regions that a task looks at together, about
WINDOW = 2                        # a window of sizes is this many steps of the similarity wide
LENGTH_BITS = 6                   # of a shingle's hash, for the length of its words
LENGTHS = 1 << LENGTH_BITS

_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                               0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


class _WordHashes(dict):
    """Hashes of the words that this worker has seen."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()


def shingles(text: bytes, n: int) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct shingles of ``n`` words; of
    fewer words the whole sequence is one; of none there are none.  The top
    LENGTH_BITS bits make long shingles sort first."""
    words = text.lower().split()      # bytes: A-Z, and the six white-space bytes
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > MAX_CACHE:
        _words.clear()
    a = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(n, len(words))
    size = np.cumsum(np.fromiter(map(len, [b""] + words), np.int64, len(words) + 1))
    size = np.minimum(size[k:] - size[:-k], LENGTHS - 1)
    h = np.full(len(words) - k + 1, k, np.uint64)      # k: no short sequence equals a full shingle
    for i in range(k):
        h = (h ^ (h >> np.uint64(29))) * _MIX[i % len(_MIX)] + a[i:len(a) - k + 1 + i]
    h ^= h >> np.uint64(31)
    h *= _MIX[1]
    h ^= h >> np.uint64(29)
    h >>= np.uint64(LENGTH_BITS)
    h |= (LENGTHS - 1 - size).astype(np.uint64) << np.uint64(64 - LENGTH_BITS)
    return np.unique(h)


def prefix_length(size, percent: int):
    """First shingles that a set must share with any set that is similar."""
    return size - (percent * size + 99) // 100 + 1


def _order(s: np.ndarray, common_shingles: np.ndarray) -> np.ndarray:
    """The shingles in their fixed order."""
    if not len(common_shingles):
        return s
    at = np.minimum(np.searchsorted(common_shingles, s), len(common_shingles) - 1)
    late = common_shingles[at] == s
    return np.concatenate([s[~late], s[late]])


def bitmap(s: np.ndarray, percent: int) -> bytes:
    """A bit for each place, told by the lowest bits of the hash: whether an
    odd number of shingles fall there.  Of bits there are four times as many
    as similar sets of this size can differ in, or more: unlike sets differ in
    half of them.  XOR of the halves of a map is the map of half as many bits."""
    bits = max(LEAST_BITS, 1 << (8 * len(s) * (100 - percent) // (100 + percent)).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Maps:
    """The bitmaps of many sets as arrays of 64-bit words: by the number of
    words, those of this size and the larger ones, folded to it."""

    def __init__(self, bits: pa.Array | pa.ChunkedArray):
        raw = pa.concat_arrays(bits.chunks) if isinstance(bits, pa.ChunkedArray) else bits
        size = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = np.frombuffer(b"".join(raw.to_pylist()), np.uint64)
        self.words, start = size // 8, np.cumsum(size) // 8 - size // 8
        self.place: dict[int, np.ndarray] = {}
        self.maps: dict[int, np.ndarray] = {}
        w, least = int(self.words.max(initial=0)), int(self.words.min(initial=1))
        rows, m = np.zeros(0, np.int64), np.zeros((0, w), np.uint64)
        while w >= least:
            own = np.flatnonzero(self.words == w)
            rows = np.concatenate([rows, own])
            m = np.concatenate([m, flat[start[own][:, None] + np.arange(w)]])
            self.place[w] = place = np.zeros(len(size), np.int64)
            place[rows] = np.arange(len(rows))
            self.maps[w] = m
            m, w = m[:, :w // 2] ^ m[:, w // 2:], w // 2

    def folded(self, words: int) -> np.ndarray:
        """The maps of all rows, in ``words`` words or fewer than any has."""
        least = int(self.words.min())
        m = self.maps[least][self.place[least]]
        while m.shape[1] > words:
            m = m[:, :m.shape[1] // 2] ^ m[:, m.shape[1] // 2:]
        return m

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each pair of rows: at least so many shingles are in one of the
        two sets only."""
        out, least = np.zeros(len(i), np.int64), np.minimum(self.words[i], self.words[j])
        for w in np.unique(least).tolist():
            at, m, place = np.flatnonzero(least == w), self.maps[w], self.place[w]
            step = max(1, COMPARE // (8 * w))
            for c in range(0, len(at), step):
                k = at[c:c + step]
                out[k] = np.bitwise_count(m[place[i[k]]] ^ m[place[j[k]]]).sum(axis=1, dtype=np.int64)
        return out


SIGNATURE = "struct<n:bigint,a:bigint,b:bigint,first:array<bigint>,bits:binary>"


def signature_column(text: Column, n: int, percent: int, common_shingles: np.ndarray) -> Column:
    """Set size, 128-bit digest of the set, its first shingles, its bitmap."""
    def signatures(texts: pa.Array) -> pa.Array:
        size, a, b, first, bits, cut = [], [], [], [], [], [0]
        for t in texts:
            s = shingles(t.as_buffer().to_pybytes(), n)
            d = xxhash.xxh3_128_digest(s.tobytes())
            size.append(len(s))
            a.append(int.from_bytes(d[:8], "big", signed=True))
            b.append(int.from_bytes(d[8:], "big", signed=True))
            p = prefix_length(len(s), percent) if len(s) else 0
            first.append(_order(s, common_shingles)[:p])
            bits.append(bitmap(s, percent))
            cut.append(cut[-1] + p)
        flat = (np.concatenate(first) if first else np.zeros(0, np.uint64)).view(np.int64)
        return pa.StructArray.from_arrays(
            [pa.array(size, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
             pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat)), pa.array(bits, pa.binary())],
            names=["n", "a", "b", "first", "bits"])

    @F.arrow_udf(SIGNATURE)
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from map(signatures, batches)
        _words.clear()          # the worker outlives the task
    return udf(common.utf8(text))


def common_shingles(docs: DataFrame, n: int) -> np.ndarray:
    """Shingles of SEEN or more documents of a sample of about SAMPLE: the
    sample and the list are bounded, and only order the shingles."""
    total = docs.count()
    share = int(min(1.0, SAMPLE / max(total, 1)) * (1 << 20))
    some = docs.where(F.pmod(F.xxhash64("text", F.lit("order")), F.lit(1 << 20)) < share).select("text").distinct()
    h = some.select(F.explode(sample_column(F.col("text"), n)).alias("h"))
    often = h.groupBy("h").count().where(F.col("count") >= SEEN).orderBy(F.desc("count"), "h").limit(COMMON)
    return np.sort(np.array([r["h"] for r in often.select("h").collect()], np.int64).view(np.uint64))


def sample_column(text: Column, n: int) -> Column:
    @F.arrow_udf("array<bigint>")
    def udf(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(t.as_buffer().to_pybytes(), n).view(np.int64) for t in texts], pa.list_(pa.int64()))
    return udf(common.utf8(text))


# ---- pairs -------------------------------------------------------------------
def bounded_pairs(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (x, y) whose bitmaps do not rule them out; ``heads`` are
    (x, n, bits)."""
    @F.arrow_udf("bigint")
    def udf(a: pa.Array, b: pa.Array) -> pa.Array:
        i = np.arange(len(a))
        return pa.array(Maps(pa.chunked_array([a, b])).differ(i, i + len(a)), pa.int64())
    h = heads.select("x", F.col("n").alias("nx"), F.col("bits").alias("bx"))
    g = heads.select(F.col("x").alias("y"), F.col("n").alias("ny"), F.col("bits").alias("by"))
    fits = F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent
    near = udf("bx", "by") * (100 + percent) <= (F.col("nx") + F.col("ny")) * (100 - percent)
    return pairs.join(h, "x").join(g, "y").where(fits).where(near).select("x", "y").distinct()


class _Sets(dict):
    """Shingle sets of the texts that this worker has met last."""

    held = 0

    def of(self, text: bytes, n: int) -> np.ndarray:
        s = self.get((n, text))
        if s is None:
            s = shingles(text, n)
            if self.held + len(s) > MAX_SETS:
                self.drop()
            self.held += len(s)
            self[n, text] = s
        return s

    def drop(self) -> None:
        self.clear()
        self.held = 0


_sets = _Sets()


def overlap_column(x: Column, y: Column, n: int) -> Column:
    """The exact overlap of the sets of two texts, and both sizes."""
    def overlaps(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(a, b):
            s, t = shingles(p.as_buffer().to_pybytes(), n), _sets.of(q.as_buffer().to_pybytes(), n)
            out.append((len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t)))
        return pa.StructArray.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)],
                                          names=["inter", "nx", "ny"])

    @F.arrow_udf("struct<inter:bigint,nx:bigint,ny:bigint>")
    def udf(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            yield overlaps(a, b)
        _words.clear()          # the worker outlives the task
        _sets.drop()
    return udf(common.utf8(x), common.utf8(y))


def similar(percent: int) -> Column:
    return (F.col("inter") > 0) & (F.col("inter") * 100 >= F.lit(percent) * (F.col("nx") + F.col("ny") - F.col("inter")))


class Links:
    """Verified links and the component of every point that has one."""

    def __init__(self, docs: DataFrame, n: int, percent: int):
        self.docs, self.n, self.percent = docs, n, percent
        self.edges: DataFrame | None = None
        self.labels: DataFrame | None = None

    def add(self, edges: DataFrame) -> None:
        """``edges`` (x, y) are stored links."""
        if edges.isEmpty():
            return
        self.edges = edges if self.edges is None else self.edges.union(edges)
        # old components stand for the old edges
        old = [] if self.labels is None else [self.labels.select(F.col("x").alias("a"), F.col("label").alias("b"))]
        new = edges.select(F.col("x").alias("a"), F.col("y").alias("b"))
        for o in old:
            new = new.union(o)
        self.labels = common.store(components_of(new), "jaccard-labels")

    def label(self, df: DataFrame, x: str, name: str) -> DataFrame:
        if self.labels is None:
            return df.withColumn(name, F.col(x))
        side = self.labels.select(F.col("x").alias(x), F.col("label").alias("__l"))
        return df.join(side, x, "left").withColumn(name, F.coalesce("__l", x)).drop("__l")

    def open(self, pairs: DataFrame) -> DataFrame:
        """The ``pairs`` (x, y) whose components differ still."""
        p = self.label(self.label(pairs, "x", "lx"), "y", "ly")
        return p.where("lx <> ly").drop("lx", "ly")

    def overlaps(self, pairs: DataFrame) -> DataFrame:
        """(x, y, inter, nx, ny) of the stored ``pairs``: the texts of x are
        sent to those of y, once a pair (texts compress, sets of hashes do
        not); where all texts of y take MAX_TEXTS bytes or fewer, those are
        sent to every task instead."""
        ids = pairs.select(F.col("x").alias("doc_id")).union(pairs.select(F.col("y").alias("doc_id"))).distinct()
        ids, few = common.store(ids, "jaccard-need"), pairs.count() <= MAX_BROADCAST
        small = lambda df: F.broadcast(df) if few else df
        own = self.docs.join(small(ids), "doc_id", "left_semi").select("doc_id", "text")
        own = common.store(own, "jaccard-texts")
        x = own.select(F.col("doc_id").alias("x"), F.col("text").alias("tx")).join(small(pairs), "x")
        y = own.select(F.col("doc_id").alias("y"), F.col("text").alias("ty"))
        y = common.store(y.join(small(pairs.select("y").distinct()), "y", "left_semi"), "jaccard-other")
        # pivots are few: their texts go to the points, whose own are not moved
        if (y.agg(F.sum(F.octet_length("ty") + 32)).first()[0] or 0) <= MAX_TEXTS:
            y = F.broadcast(y)
        return x.join(y, "y").select("x", "y", overlap_column(F.col("tx"), F.col("ty"), self.n).alias("o")).select("x", "y", "o.*")

    def verify(self, pairs: DataFrame) -> None:
        """Link the ``pairs`` that are similar."""
        pairs = common.store(pairs.select("x", "y"), "jaccard-check")
        if pairs.isEmpty():
            return
        got = self.overlaps(pairs).where(similar(self.percent)).select("x", "y")
        self.add(common.store(got, "jaccard-links"))

    def settle(self, pairs: DataFrame) -> None:
        """Link the stored ``pairs`` that are similar: one of each point first,
        then those of the rest whose components differ still."""
        first = pairs.groupBy("x").agg(F.min("y").alias("y"))
        self.verify(first)
        self.verify(self.open(pairs.join(first, ["x", "y"], "left_anti")))


def components_of(edges: DataFrame) -> DataFrame:
    return common.components(edges, "jaccard").select(F.col("node").alias("x"), F.col("component").alias("label"))


# ---- regions -----------------------------------------------------------------
def size_windows(n: Column, percent: int) -> Column:
    """The windows of a set size: its own, and the next if that holds sizes
    that can match.  The small term keeps rounding on the safe side."""
    import math
    v = F.log(n) / F.lit(WINDOW * (-math.log(percent / 100) + 1e-9))
    return F.array_distinct(F.array(F.floor(v), F.floor(v + 1 / WINDOW)))


def can_be_first(n, pos, m, at, percent: int) -> Column:
    """Whether the shingle at ``pos`` of a set of ``n`` and at ``at`` of one of
    ``m`` can be the first that they share, if they are similar: what follows
    must hold the overlap."""
    n, pos, m, at = (F.col(c) for c in (n, pos, m, at))
    return F.least(n - pos, m - at) * (100 + percent) >= (n + m) * percent


def regions(sigs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """(region, x, n, pos, weight): points that share a first shingle, at
    ``pos`` in their order, with another in a window of sizes.  ``sigs`` hold
    a row a document, ``points`` (x, a, b, n, weight) one a distinct set."""
    first = sigs.select(F.posexplode("first").alias("pos", "token"), "a", "n").withColumn("pos", F.col("pos").cast("long"))
    # the smaller set of a pair has the first shingle they share among these
    early = F.max(F.col("pos") * (100 + percent) <= F.col("n") * (100 - percent)).alias("early")
    # tokens of two points or more, told by the least and greatest digest
    often = first.groupBy("token").agg(F.min("a").alias("lo"), F.max("a").alias("hi"), early)
    often = common.store(often.where("lo <> hi and early").select("token"), "jaccard-tokens")
    held = first.join(often, "token", "left_semi").select("token", "a", "pos").distinct()
    held = held.join(points.select("x", "a", "n", "weight"), "a")
    held = held.select(F.explode(size_windows(F.col("n"), percent)).alias("win"), "token", "x", "n", "pos", "weight")
    held = held.select(F.xxhash64("token", "win").alias("region"), "x", "n", "pos", "weight")
    held = common.store(held, "jaccard-windows")
    early = F.max(F.col("pos") * (100 + percent) <= F.col("n") * (100 - percent)).alias("early")
    many = held.groupBy("region").agg(F.count("*").alias("m"), early).where("m > 1 and early").select("region")
    return common.store(held.join(common.store(many, "jaccard-many"), "region", "left_semi"), "jaccard-regions")


def pivot_of() -> Column:
    """The heaviest point, then the least."""
    return F.max_by(F.struct("x", "n", "pos"), F.struct("weight", -F.col("x"))).alias("pivot")


def unsettled(members: DataFrame, links: Links) -> DataFrame:
    """``members`` of regions that hold points of several components, with
    ``label`` and the region's number of points ``m``."""
    lab = common.store(links.label(members, "x", "label"), "jaccard-members")
    live = lab.groupBy("region").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count("*").alias("m"))
    live = common.store(live.where("l0 <> l1").select("region", "m"), "jaccard-live")
    return lab.join(live, "region")


def near_pairs(members: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) of different components within bounded regions, of
    sizes that can match, whose first common shingle the region's can be
    (``pos`` 0: any), and that the bitmaps do not rule out.  Regions are met
    by the bucket, each row with those that follow it in its region."""
    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by("region")
        region, x, n, label, pos = (t[c].to_numpy() for c in ("region", "x", "n", "label", "pos"))
        maps = Maps(t["bits"])
        a, b = [], []
        for d in range(1, len(x)):
            i = np.flatnonzero(region[d:] == region[:-d])
            if not len(i):
                break
            j = i + d
            total = n[i] + n[j]
            fit = (label[i] != label[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            fit &= np.minimum(n[i] - pos[i], n[j] - pos[j]) * (100 + percent) >= total * percent
            i, j = i[fit], j[fit]
            near = maps.differ(i, j) * (100 + percent) <= total[fit] * (100 - percent)
            a.append(x[i[near]])
            b.append(x[j[near]])
        pairs = np.stack([np.concatenate(a), np.concatenate(b)]) if a else np.zeros((2, 0), np.int64)
        pairs = np.unique(np.sort(pairs, axis=0), axis=1)
        return pa.table({"x": pa.array(pairs[0], pa.int64()), "y": pa.array(pairs[1], pa.int64())})
    buckets = members.count() // BUCKET + 1
    held = members.select(F.pmod(F.xxhash64("region"), F.lit(buckets)).alias("bucket"), "region", "x", "label", "pos").distinct()
    return held.join(heads, "x").groupBy("bucket").applyInArrow(one, "x bigint, y bigint").distinct()


def families(members: DataFrame) -> DataFrame:
    """Large regions (region, x, n, weight): those with the same least point
    as one region, where all their points together make fewer pairs than the
    regions do one by one.  The many first shingles that a family of near
    copies shares are then met once; regions that have but a few points in
    common stay apart."""
    low = members.groupBy("region").agg(F.min("x").alias("b"), F.count("*").alias("m"))
    low = common.store(low, "jaccard-least")
    every = members.select("region", "x", "n", "weight").join(low, "region")
    fam = common.store(every.select("b", "x", "n", "weight").distinct(), "jaccard-families")
    size = fam.groupBy("b").agg(F.count("*").alias("u"))
    apart = low.groupBy("b").agg(F.sum(F.col("m") * F.col("m")).alias("apart"))
    size = common.store(size.join(apart, "b").select("b", "u", (F.col("u") * F.col("u") <= F.col("apart")).alias("whole")),
                        "jaccard-whole")
    whole = fam.join(size.where("whole"), "b").select(
        F.xxhash64("b", F.lit("family")).alias("region"), "x", "n", "weight", F.col("u").alias("m"))
    single = every.join(size.where("not whole"), "b", "left_semi").select("region", "x", "n", "weight", "m")
    return whole.union(single)


def block_pairs(members: DataFrame, size: int) -> DataFrame:
    """Regions that do not recur: their points in blocks of about ``size``,
    and one region for each pair of blocks."""
    n = F.ceil(F.col("m") / size).cast("long")
    block = F.pmod(F.xxhash64("x", F.lit("block")), n)
    each = members.withColumn("blk", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return each.select(F.xxhash64("region", F.least("blk", "other"), F.greatest("blk", "other")).alias("region"),
                       "x", "label", F.lit(0).cast("long").alias("pos"))


def voronoi(members: DataFrame, heads: DataFrame, links: Links, percent: int) -> DataFrame:
    """One recursion of large regions (region, x, weight, m): links to their
    pivots are added to ``links``; gives the points in their new regions
    (region, x, n, weight, parent).  The distance is that of the bitmaps, all
    folded to the least size in the region; similar sets are at most
    n * (100 - percent) / percent apart, n being the size of either."""
    def measured(t: pa.Table, p: pa.Table) -> pa.Table:
        if not len(t) or not len(p):
            return pa.table({c: pa.array([], kind) for c, kind in cells})
        x, n, weight, y, m = (c.to_numpy() for c in (t["x"], t["n"], t["weight"], p["y"], p["m"]))
        maps = Maps(pa.chunked_array(t["bits"].chunks + p["far"].chunks))
        words = t["words"][0].as_py()
        every = maps.folded(words)
        own, pivots = every[:len(x)], every[len(x):]
        known, found = np.isin(x, y), []
        step = max(1, COMPARE // (8 * words * len(y)))
        for c in range(0, len(x), step):
            s = slice(c, c + step)
            d = np.bitwise_count(own[s, None] ^ pivots).sum(axis=2, dtype=np.int64)
            # pairs with a pivot are asked for, so pivots need not come along
            cell = (d - d.min(axis=1, keepdims=True)) * percent <= 2 * n[s, None] * (100 - percent)
            cell &= ~known[s, None]
            total = n[s, None] + m
            ask = (d * (100 + percent) <= total * (100 - percent)) & np.where(known[s, None], x[s, None] < y, True)
            ask &= 100 * np.minimum(n[s, None], m) >= percent * np.maximum(n[s, None], m)
            i, j = np.nonzero(cell | ask)
            cell, ask = cell[i, j], ask[i, j]
            i += c
            at = np.flatnonzero(ask)
            ask[at] = maps.differ(i[at], len(x) + j[at]) * (100 + percent) <= (n[i[at]] + m[j[at]]) * (100 - percent)
            found.append((i[cell | ask], j[cell | ask], cell[cell | ask], ask[cell | ask]))
        i, j, cell, ask = (np.concatenate(f) for f in zip(*found))
        region = np.full(len(i), t["region"][0].as_py())
        return pa.table([pa.array(c, kind) for c, (_, kind) in zip((region, x[i], y[j], n[i], weight[i], cell, ask), cells)],
                        names=[c for c, _ in cells])

    cells = [(c, pa.int64()) for c in ("region", "x", "y", "n", "weight")] + [("cell", pa.bool_()), ("ask", pa.bool_())]
    held = common.store(members.select("region", "x", "weight", "m").join(heads, "x"), "jaccard-held")
    most = held.groupBy("region").agg(F.max_by("x", F.struct("weight", -F.col("x"))).alias("heavy"),
                                      F.floor(F.min(F.octet_length("bits")) / 8).alias("words"))
    drawn = F.pmod(F.xxhash64("x", F.lit("pivot")), F.ceil(F.sqrt("m")).cast("long")) == 0
    chunks = F.ceil(F.col("m") / CHUNK).cast("long")
    left = held.join(most, "region")
    right = left.where(drawn | (F.col("x") == F.col("heavy")))
    left = left.withColumn("chunk", F.pmod(F.xxhash64("x", F.lit("chunk")), chunks)).select(
        "region", "chunk", "x", "n", "weight", "bits", "words")
    right = right.select(F.col("region").alias("of"), F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("part"),
                         F.col("x").alias("y"), F.col("n").alias("m"), F.col("bits").alias("far"))
    met = left.groupBy("region", "chunk").cogroup(right.groupBy("of", "part")).applyInArrow(
        measured, "region bigint, x bigint, y bigint, n bigint, weight bigint, cell boolean, ask boolean")
    met = common.store(met, "jaccard-dist")
    links.settle(common.store(links.open(met.where("ask").select("x", "y").distinct()), "jaccard-ask"))
    return met.where("cell").select(F.xxhash64("region", "y").alias("region"), "x", "n", "weight", F.col("region").alias("parent"))


def components(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, small: int = SMALL) -> DataFrame:
    """(doc_id, a, b, n_shingles, component_id): a row for every row of
    ``docs`` (doc_id, text).

    Two documents are linked when 100 * |intersection| >= percent * |union| of
    their sets of distinct shingles of ``n`` words; a component is named by its
    least doc_id.  Null, empty and wordless texts have no shingles, are linked
    with nothing, and are components of their own.  A null doc_id names
    nothing: such a row belongs to the component of the rows with an equal
    set, and is null where there is none.  Repeated rows are linked.  Rows
    that share a doc_id and differ in text are joined through it.
    """
    spark = docs.sparkSession
    common.prepare(spark, common.SMALL_BATCH)
    docs = docs.select("doc_id", "text")
    order = common_shingles(docs, n)
    sigs = docs.select("doc_id", signature_column(F.col("text"), n, percent, order).alias("g")).select("doc_id", "g.*")
    sigs = common.store(sigs, "jaccard-signatures")
    # distinct sets, named by their least doc_id
    points = sigs.where("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("x"), F.count("*").alias("weight"),
                                                       F.min("n").alias("n"))
    points = common.store(points, "jaccard-points")
    named = points.where("x is not null")
    members = regions(sigs, named, percent)
    need = common.store(members.select("x").distinct(), "jaccard-need")
    # of equal sets, the row (or equal rows) of the least doc_id
    named = named.join(need, "x").select("a", "b", "x")
    heads = sigs.select("a", "b", F.col("doc_id").alias("x"), "n", "bits").join(named, ["a", "b", "x"])
    heads = common.store(heads.select("x", "n", "bits").distinct(), "jaccard-heads")
    links = Links(docs, n, percent)

    # round 1: every point against the pivots of its regions, one of them first
    pivots = members.groupBy("region").agg(pivot_of()).select(
        "region", F.col("pivot.x").alias("y"), F.col("pivot.n").alias("m"), F.col("pivot.pos").alias("at"))
    star = members.join(pivots, "region").where("x <> y").where(can_be_first("n", "pos", "m", "at", percent))
    star = star.select("x", "y").distinct()
    star = common.store(bounded_pairs(star, heads, percent), "jaccard-star")
    links.settle(star)

    # further rounds: regions of several components, without their pivot; those
    # that go on have at most 3/4 of their parent's points, so the rounds end
    members = members.join(pivots.select("region", F.col("y").alias("x")), ["region", "x"], "left_anti").select(
        "region", "x", "n", "pos", "weight")
    parted = False          # whether the regions are cells of larger ones
    while True:
        live = common.store(unsettled(members, links), "jaccard-open")
        if live.isEmpty():
            break
        few = near_pairs(common.store(live.where(F.col("m") <= small), "jaccard-small"), heads, percent)
        links.verify(links.open(common.store(few, "jaccard-pairs")))
        large = live.where(F.col("m") > small)
        if large.isEmpty():
            break
        large = large.select("region", "x", "n", "weight", "m")
        large = common.store(large if parted else families(large), "jaccard-large")
        cells = common.store(voronoi(large, heads, links, percent), "jaccard-cells")
        # parents of one component are done; so are cells that became small enough to go on with
        live = common.store(unsettled(large.select("region", "x", "n", "weight"), links), "jaccard-open")
        most = cells.groupBy("parent", "region").agg(F.count("*").alias("c")).groupBy("parent").agg(F.max("c").alias("c"))
        shape = live.select("region", "m").distinct().join(most, F.col("region") == F.col("parent"), "left")
        shape = common.store(shape.select("region", ((F.col("m") > BLOCK * small) & (F.coalesce("c", F.lit(0)) <= 0.75 * F.col("m"))).alias("shrunk")), "jaccard-shape")
        alike = block_pairs(live.join(shape.where(~F.col("shrunk")), "region", "left_semi"), BLOCK * small)
        rest = common.store(near_pairs(common.store(alike, "jaccard-alike"), heads, percent), "jaccard-blocks")
        links.settle(rest)
        parted, down = True, shape.where("shrunk").select(F.col("region").alias("parent"))
        members = common.store(cells.join(down, "parent", "left_semi").select("region", "x", "n", F.lit(0).cast("long").alias("pos"), "weight"),
                               "jaccard-next")
    out = sigs.select("doc_id", "a", "b", F.col("n").alias("n_shingles"))
    out = out.join(points.select("a", "b", "x"), ["a", "b"], "left")
    out = links.label(out, "x", "component")
    return out.select("doc_id", "a", "b", "n_shingles",
                      F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def near_duplicates(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: the one with the least doc_id
    (of rows that share it, the one with the least MD5 of the text).
    Documents that are linked with nothing all stay, as do rows without words
    or doc_id."""
    c = components(docs, n, percent).where("n_shingles > 0 and doc_id <=> component_id")
    keep = common.store(c.groupBy("doc_id").agg(F.count("*").alias("rows")), "jaccard-kept")
    twice = common.store(keep.where("rows > 1").select("doc_id"), "jaccard-twice")
    keep, twice = (F.broadcast(x) if x.count() <= MAX_BROADCAST else x for x in (keep.select("doc_id"), twice))
    words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    linked = docs.where(words & F.col("doc_id").isNotNull()).join(keep, "doc_id", "left_semi").select(docs.columns)
    once = linked.join(twice, "doc_id", "left_anti").select(docs.columns)
    more = (linked.join(twice, "doc_id", "left_semi").select("doc_id", "text", common.pack(docs))
            .groupBy("doc_id").agg(F.min_by(common.ROW, F.md5(common.utf8(F.col("text")))).alias(common.ROW)))
    return once.union(common.unpack(more)).union(docs.where(~words | F.col("doc_id").isNull()))
