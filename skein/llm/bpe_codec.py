"""BPE encoding and decoding by batched merge rounds.

The words that an Arrow batch has and the worker does not know yet go, as
symbols of all words together, into one flat array.  Each round forms the keys
of all adjacent pairs, finds their ranks by binary search over the sorted pair
keys, takes the lowest rank of every word, and merges that pair wherever the
word has it; words in which no pair is known any more leave the array.  A word
of up to SHORT symbols needs fewer rounds than that.

Longer words (scripts without spaces, junk) would be read anew for every rank
they hold.  Their flat array is linked instead: a round takes the lowest rank
that any of them still has, merges its places, and looks up only the pairs
beside a merge, so that a round costs what it merges and a word's time is
nearly linear in its length.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm import bpe, common

MAX_CACHE = 32 << 20      # bytes of words and ids a worker remembers within a task
FLAT = 1 << 15            # symbols in one flat array, about
SHORT = 64                # symbols from which a word's places are linked
RUN = 1 << 20             # characters of texts cut into words at once
NONE = np.iinfo(np.int64).max


def merge_rounds(v: bpe.Vocabulary, words: list[bytes]) -> list[bytes]:
    """The ids of each word (bytes, at least one), as little-endian 32-bit."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(lens)
    sym = v.inner[flat]
    sym[ends - 1] = v.last[flat[ends - 1]]
    word = np.repeat(np.arange(len(words)), lens)
    done_sym, done_word = [], []
    while len(sym):
        key = sym[:-1] * v.size + sym[1:]
        at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
        known = (v.keys[at] == key) & (word[:-1] == word[1:])
        rank = np.append(np.where(known, v.rank[at], NONE), NONE)
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        low = np.minimum.reduceat(rank, starts)
        size = np.diff(np.append(starts, len(sym)))
        over = np.repeat(low == NONE, size)
        if over.any():
            done_sym.append(sym[over])
            done_word.append(word[over])
        hit = (rank == np.repeat(low, size)) & ~over
        pos = np.flatnonzero(hit)
        if len(pos):
            # of a run of touching hits every other one merges, from the left
            head = np.append(True, np.diff(pos) > 1)
            run = np.arange(len(pos)) - np.maximum.accumulate(np.where(head, np.arange(len(pos)), 0))
            if not v.in_order:      # one merge a word and round, the leftmost
                first = np.append(True, word[pos][1:] != word[pos][:-1])
                pos = pos[first]
            else:
                pos = pos[run % 2 == 0]
            sym[pos] = v.made[at[pos]]
            keep = ~over
            keep[pos + 1] = False
        else:
            keep = ~over
        sym, word = sym[keep], word[keep]
    if not done_sym:
        return []
    sym, word = np.concatenate(done_sym), np.concatenate(done_word)
    order = np.argsort(word, kind="stable")
    raw = sym[order].astype("<u4").tobytes()
    cut = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))]) * 4
    return [raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


class Places:
    """Places of known pairs by rank: the ranks as a heap, a list of arrays a rank."""

    def __init__(self):
        self.heap: list[int] = []
        self.at: dict[int, list[np.ndarray]] = {}

    def add(self, rank: np.ndarray, place: np.ndarray) -> None:
        order = np.argsort(rank, kind="stable")
        rank, place = rank[order], place[order]
        cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for r, p in zip(rank[np.append(0, cut)].tolist(), np.split(place, cut)):
            if r in self.at:
                self.at[r].append(p)
            else:
                self.at[r] = [p]
                heapq.heappush(self.heap, r)

    def lowest(self) -> tuple[int, np.ndarray]:
        r = heapq.heappop(self.heap)
        return r, np.unique(np.concatenate(self.at.pop(r)))


def merge_linked(v: bpe.Vocabulary, words: list[bytes]) -> list[bytes]:
    """As merge_rounds, for long words.  Needs a vocabulary whose symbols are
    made before the pairs that hold them: a round then only makes pairs of
    higher ranks than its own, and all words can take one rank together."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(lens)
    n = len(flat)
    sym = np.append(v.inner[flat], -1)          # place n stands for the end of a word
    sym[ends - 1] = v.last[flat[ends - 1]]
    after = np.arange(1, n + 2)
    after[ends - 1] = n
    before = np.arange(-1, n)
    before[ends - lens] = n
    word = np.repeat(np.arange(len(words)), lens)
    places = Places()

    def look_up(p: np.ndarray) -> None:
        p = p[after[p] < n]
        key = sym[p] * v.size + sym[after[p]]
        at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
        known = v.keys[at] == key
        if known.any():
            places.add(v.rank[at[known]], p[known])

    look_up(np.arange(n))
    while places.heap:
        r, p = places.lowest()
        left, right, made = v.by_rank[r]
        p = p[(sym[p] == left) & (sym[after[p]] == right)]
        if left == right and len(p) > 1:        # of a run of touching places every other one
            head = np.append(True, after[p[:-1]] != p[1:])
            at = np.arange(len(p))
            p = p[(at - np.maximum.accumulate(np.where(head, at, 0))) % 2 == 0]
        if not len(p):
            continue
        gone = after[p]
        sym[p], sym[gone] = made, -1
        after[p] = after[gone]
        before[after[p]] = p
        before[n] = n
        prev = before[p]
        look_up(np.unique(np.concatenate([prev[prev < n], p])))
    keep = sym[:n] >= 0
    raw = sym[:n][keep].astype("<u4").tobytes()
    cut = np.concatenate([[0], np.cumsum(np.bincount(word[keep], minlength=len(words)))]) * 4
    return [raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


class Codec:
    def __init__(self, path: str):
        self.v = bpe.load(path)
        self.release()
        names = [(self.v.tokens.get(i, "") + " ").encode() for i in range(self.v.size)]
        self.flat = np.frombuffer(b"".join(names), np.uint8)
        self.len = np.fromiter(map(len, names), np.int64, len(names))
        self.start = np.cumsum(self.len) - self.len

    def release(self) -> None:
        """Forget the words: a worker outlives its tasks."""
        self.known: dict[str, bytes] = {}
        self.held = 0

    def learn(self, words) -> dict[str, bytes]:
        """Add the ids of ``words`` to the known ones; gives those that are not
        remembered (long words, and all where the memory was full)."""
        new = [w for w in words if w not in self.known]
        raw = [w.encode() for w in new]
        linked = [i for i, r in enumerate(raw) if len(r) > SHORT] if self.v.in_order else []
        ids = dict(zip([new[i] for i in linked], merge_linked(self.v, [raw[i] for i in linked]))) if linked else {}
        if linked:
            rest = [i for i, w in enumerate(new) if w not in ids]
            new, raw = [new[i] for i in rest], [raw[i] for i in rest]
        size, begin, found = 0, 0, {}
        for i, r in enumerate(raw):
            size += len(r)
            if size >= FLAT or i + 1 == len(raw):
                found.update(zip(new[begin:i + 1], merge_rounds(self.v, raw[begin:i + 1])))
                size, begin = 0, i + 1
        more = sum(128 + len(r) + len(found[w]) for w, r in zip(new, raw))
        if self.held + more > MAX_CACHE:
            got = {w: self.known[w] for w in words if w in self.known}
            self.release()
            return got | found | ids
        self.known.update(found)
        self.held += more
        return ids

    def encode(self, text: str) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers."""
        return encode_many(self, [text])[0]

    def decode(self, ids: bytes | np.ndarray) -> bytes:
        """The decoded text in UTF-8: the file names no decoder, so the symbols
        stand as they are, with a space between."""
        a = (np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else ids).astype(np.int64)
        if not len(a):
            return b""
        n = self.len[a]
        end = np.cumsum(n)
        at = np.arange(end[-1]) + np.repeat(self.start[a] - (end - n), n)
        return self.flat[at].tobytes()[:-1]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec a worker and vocabulary."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def runs(texts: pa.Array) -> Iterator[list[str]]:
    """The texts of an Arrow array in runs of about RUN characters."""
    run, chars = [], 0
    for t in texts:
        run.append(t.as_py())
        chars += len(run[-1])
        if chars >= RUN:
            yield run
            run, chars = [], 0
    if run:
        yield run


def encode_many(c: Codec, texts: list[str]) -> list[bytes]:
    """encode() of each text, with the unknown words of all learnt at once."""
    cut = [list(c.v.pieces(t)) for t in texts]
    need = set()
    for parts in cut:
        for words, _ in parts:
            need.update(words)
    extra = c.learn(need)
    known, out = c.known, []
    for parts in cut:
        got = []
        for words, special in parts:
            if special is not None:
                got.append(special.to_bytes(4, "little"))
            else:
                got += [known.get(w) or extra[w] for w in words] if extra else [known[w] for w in words]
        out.append(b"".join(got))
    return out


def id_lists(ids: list[bytes]) -> pa.ListArray:
    """Little-endian ids of texts as array<int>, without an object an id."""
    cut = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cut), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def encode_column(text: Column, path: str) -> Column:
    """The ids of each text, as an array<int>; null as of an empty text."""
    @F.arrow_udf("array<int>")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path)
        for texts in batches:
            yield id_lists([ids for run in runs(texts) for ids in encode_many(c, run)])
        c.release()
    return udf(F.coalesce(text, F.lit("")))


def decode_column(ids: Column, path: str) -> Column:
    """The text of each array of ids; null stays null."""
    @F.arrow_udf("string")
    def udf(arrays: pa.Array) -> pa.Array:
        c = codec(path)
        return pa.array([None if a.values is None else c.decode(a.values.to_numpy(zero_copy_only=False)).decode()
                         for a in arrays], pa.string())
    return udf(ids)


CODED = "struct<ids:array<int>,n_decoded:bigint>"


def codec_column(text: Column, path: str) -> Column:
    """The ids of each text and the length of what they decode to: text by
    text, so that no more than one decoded text is held."""
    @F.arrow_udf(CODED)
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path)
        for texts in batches:
            ids = [x for run in runs(texts) for x in encode_many(c, run)]
            n = pa.array([len(c.decode(x).decode()) for x in ids], pa.int64())
            yield pa.StructArray.from_arrays([id_lists(ids), n], names=["ids", "n_decoded"])
        c.release()
    return udf(F.coalesce(text, F.lit("")))


DIGEST = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"


def round_trip_column(text: Column, path: str) -> Column:
    """Encode, decode, and digest both: the ids themselves stay in the task."""
    @F.arrow_udf(DIGEST)
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path)
        for texts in batches:
            n, a, b = [], [], []
            for run in runs(texts):
                for ids in encode_many(c, run):
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                names=["n_tokens", "ids_sha256", "decoded_sha256"])
        c.release()
    return udf(F.coalesce(text, F.lit("")))


def round_trip(docs: DataFrame, path: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """(__row, n_tokens, ids_sha256, decoded_sha256) for every row of ``docs``.

    A null text counts as empty: no ids, an empty decoded text.  Repeated rows
    are encoded alike; an empty table gives an empty result.  Very long texts
    and words are encoded whole, in time nearly linear in their length.
    """
    common.prepare(docs.sparkSession, common.SMALL_BATCH)
    r = round_trip_column(F.col("text"), path or bpe.default_path())
    return docs.select(common.pack(docs.select(carry or docs.columns)), r.alias("r")).select(common.ROW, "r.*")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with its rows in ``__row`` and ``ids`` array<int> beside."""
    common.prepare(docs.sparkSession, common.SMALL_BATCH)
    return docs.select(common.pack(docs), encode_column(F.col("text"), path or bpe.default_path()).alias("ids"))


def encode_and_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(__row, ids, n_decoded) for every row of ``docs``: the ids of its text
    and the characters that they decode to.  Null, empty, repeated and very
    long texts are treated as by round_trip."""
    common.prepare(docs.sparkSession, common.SMALL_BATCH)
    return docs.select(common.pack(docs), codec_column(F.col("text"), path or bpe.default_path()).alias("c")).select(
        common.ROW, "c.*")
