"""Token counts by heap-and-linked-list byte-pair merging.

A word's symbols form a linked list; a heap holds its known pairs by rank and
place.  The lowest pair is popped and merged, and the two pairs it makes with
its neighbours are pushed, until the heap is empty.  The count is the number
of first symbols less the merges; no ids are given out.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm import bpe, common

LIMIT = 2048
MAX_CACHE = 400_000       # words a worker remembers


def count_word(pairs: dict, sym: list[int]) -> int:
    """Tokens of one word of first symbols ``sym``."""
    n = len(sym)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(*p, i) for i in range(n - 1) if (p := pairs.get((sym[i], sym[i + 1])))]
    heapify(heap)
    merges = 0
    while heap:
        rank, made, i = heappop(heap)
        j = right[i]
        # a pair that has gone or changed since it was pushed
        if sym[i] < 0 or j < 0 or pairs.get((sym[i], sym[j]), (-1,))[0] != rank:
            continue
        sym[i], sym[j] = made, -1
        merges += 1
        k = right[i] = right[j]
        if k >= 0:
            left[k] = i
            if p := pairs.get((made, sym[k])):
                heappush(heap, (*p, i))
        h = left[i]
        if h >= 0 and (p := pairs.get((sym[h], made))):
            heappush(heap, (*p, h))
    return n - merges


class Counter:
    def __init__(self, path: str):
        self.v = bpe.load(path)
        self.inner, self.last = self.v.inner.tolist(), self.v.last.tolist()
        self.known: dict[str, int] = {}

    def word(self, w: str) -> int:
        raw = w.encode()
        sym = [self.inner[b] for b in raw]
        sym[-1] = self.last[raw[-1]]
        return count_word(self.v.pairs, sym)

    def count(self, text: str) -> int:
        n, known = 0, self.known
        for words, special in self.v.pieces(text):
            if special is not None:
                n += 1
                continue
            for w in words:
                c = known.get(w)
                if c is None:
                    if len(known) >= MAX_CACHE:
                        known.clear()
                    c = known[w] = self.word(w)
                n += c
        return n


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter a worker and vocabulary."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_column(text: Column, path: str) -> Column:
    @F.arrow_udf("bigint")
    def udf(texts: pa.Array) -> pa.Array:
        c = counter(path)
        return pa.array([c.count(t.as_py()) for t in texts], pa.int64())
    return udf(F.coalesce(text, F.lit("")))


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT,
                 carry: list[str] | None = None) -> DataFrame:
    """(__row, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    A null text counts as empty: no bytes, no tokens.  Repeated rows count
    alike; an empty table gives an empty result.
    """
    common.prepare(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    out = docs.select(common.pack(docs.select(carry or docs.columns)), F.octet_length(text).cast("long").alias("n_bytes"),
                      count_column(F.col("text"), path or bpe.default_path()).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
