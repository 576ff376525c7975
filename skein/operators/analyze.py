"""Tokenising and analysing document and query tables.

Index side (per page):  collapse ws -> split -> keep alphabetic tokens ->
upper/lower fold -> Porter stem -> drop stopword / punctuation stems.
Query side: upper -> split -> lower -> Porter stem; no alphabetic filter, no
stopword filter, duplicates kept (counted as ``qtf``).

``index_terms`` states this word by word as column expressions.  The counts of
an index (``term_counts``) come from the same rules, but a task works a token
out once and remembers what became of it: texts repeat their words, and the
rules cost far more than the look-up.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from skein.functions import stopwords as sw
from skein.functions.stem import stemmer, with_stem
from skein.functions.text import PUNCTUATION, collapse_ws, fold_case, is_alpha


def tokens(docs: DataFrame, text_col: str = "text", keys=("site", "doc_key")) -> DataFrame:
    """One row per whitespace token of an already collapsed text."""
    return (docs.select(*keys, F.explode(F.split(F.col(text_col), " ")).alias("token"))
                .where(F.col("token") != ""))


def alpha_words(toks: DataFrame, keys=("site", "doc_key")) -> DataFrame:
    """X4 + X6: alphabetic tokens, case-folded, as ``word``."""
    return toks.where(is_alpha(F.col("token"))).select(*keys, fold_case(F.col("token")).alias("word"))


def drop_stop_terms(df: DataFrame, stopwords="nltk", col: str = "term") -> DataFrame:
    """X8 + X9: drop stems that are stopwords or single punctuation marks.

    The list is a bounded literal, so this is an in-set predicate evaluated
    in place (no join, no shuffle)."""
    words = sw.resolve(stopwords)
    if not words:
        return df
    return df.where(~F.col(col).isin(sorted(set(words) | set(PUNCTUATION))))


def index_terms(docs: DataFrame, stopwords="nltk", text_col: str = "text",
                keys=("site", "doc_key")) -> DataFrame:
    """One row per surviving stem occurrence: (keys..., term)."""
    words = alpha_words(tokens(docs, text_col, keys), keys)
    stemmed = with_stem(words, "word", "term").select(*keys, "term")
    return drop_stop_terms(stemmed, stopwords)


#: Tokens that a Python worker remembers, from task to task: half of them the
#: latest ones, the others those before.
TOKENS_KEPT = 300_000
KNOWN: dict[object, Terms] = {}
#: Bytes of texts that are cut and counted at a time.
SLICE_BYTES = 4 << 20


def term_of_token(stopwords="nltk"):
    """X4-X9 as a function: the term of a token, None where it has none."""
    words, stem = sw.resolve(stopwords), stemmer()
    dropped = frozenset([*words, *PUNCTUATION] if words else [])

    def term(token: str) -> str | None:
        if not token.isalpha():
            return None
        found = stem(token.upper().lower())
        return None if found in dropped else found
    return term


class Terms:
    """The terms of tokens, each worked out once while it is remembered.  What
    is asked for again in time stays, however many others come."""

    def __init__(self, stopwords):
        self.rule, self.new, self.old = term_of_token(stopwords), {}, {}

    def of(self, tokens: list[str]) -> list[str | None]:
        get = self.new.get
        out = [get(t, self) if t.isalpha() else None for t in tokens]      # self: not among the latest
        for i in [i for i, t in enumerate(out) if t is self]:
            out[i] = self.term(tokens[i])
        return out

    def term(self, token: str) -> str | None:
        if len(self.new) >= TOKENS_KEPT // 2:
            self.old, self.new = self.new, {}
        try:
            t = self.old[token]
        except KeyError:
            t = self.rule(token)
        self.new[token] = t
        return t


def known_terms(stopwords) -> Terms:
    """The worker's memory for a list; it holds that of one list only."""
    rule = stopwords if stopwords is None or isinstance(stopwords, str) else frozenset(stopwords)
    if rule not in KNOWN:
        KNOWN.clear()
        KNOWN[rule] = Terms(stopwords)
    return KNOWN[rule]


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of about SLICE_BYTES of the texts in column ``text``."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(), dtype=np.int64)
    cuts = np.flatnonzero(np.diff(ends // SLICE_BYTES)) + 1
    for start, stop in itertools.pairwise([0, *cuts.tolist(), len(batch)]):
        if stop > start:
            yield batch.slice(start, stop - start)


def pages_of(columns: list[pa.Array]) -> np.ndarray:
    """The page of each row, from 0: rows with equal keys that follow each other."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        a, b = c[1:], c[:-1]
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        new[1:] |= ~same.to_numpy(zero_copy_only=False)
    return np.cumsum(new)


def page_counts(texts: pa.Array, pages: np.ndarray, known: Terms) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(page, number of the term, the terms, tf), a row for each page and term,
    by page."""
    lists = pc.split_pattern(texts, " ")
    tokens = pc.list_flatten(lists).dictionary_encode()
    found = known.of(tokens.dictionary.to_numpy(zero_copy_only=False).tolist())
    terms = pa.array(found, pa.string()).dictionary_encode()
    n = len(terms.dictionary)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, terms.dictionary, none
    number = pc.fill_null(terms.indices, -1).to_numpy().astype(np.int64)[tokens.indices.to_numpy()]
    at = pages[pc.list_parent_indices(lists).to_numpy()] * n + number
    at = np.sort(at[number >= 0])
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first] // n, at[first] % n, terms.dictionary, np.diff(np.r_[first, len(at)])


def counts_by_page(batches: Iterable[pa.RecordBatch], width: int, stopwords) -> Iterator[tuple]:
    """(key columns, row of each count in them, terms, number of the term of
    each count, counts) of rows (keys..., text), ``width`` keys, in which those
    with equal keys follow each other: they are counted as one page.  The last
    page of a slice stays open, as the next slice may go on with it."""
    known = known_terms(stopwords)
    last, tf = None, {}                     # the open page: its row of keys, its counts

    def closed():
        n = len(tf)
        return last, np.zeros(n, np.int64), pa.array(list(tf), pa.string()), np.arange(n), np.fromiter(tf.values(), np.int64, n)

    for batch in batches:
        for part in slices(batch, width):
            columns = [part.column(i) for i in range(width)]
            pages = pages_of(columns)
            page, number, terms, counts = page_counts(part.column(width), pages, known)
            if last is not None and any(a[0].as_py() != b[0].as_py() for a, b in zip(last, columns, strict=True)):
                if tf:
                    yield closed()
                tf = {}
            elif tf and pages[-1] > 0:      # its end is in this slice
                here = page == 0
                merge(tf, terms, number[here], counts[here])
                page, number, counts = page[~here], number[~here], counts[~here]
                yield closed()
                tf = {}
            whole = page < pages[-1]
            if whole.any():
                at = np.searchsorted(pages, page[whole])               # a page's first row
                yield columns, at, terms, number[whole], counts[whole]
            merge(tf, terms, number[~whole], counts[~whole])
            last = [c.slice(len(c) - 1) for c in columns]
    if tf:
        yield closed()


def counted(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...], stopwords) -> Iterator[pa.RecordBatch]:
    """(keys..., term, tf) of rows (keys..., text), as ``counts_by_page``."""
    for columns, at, terms, number, counts in counts_by_page(batches, len(keys), stopwords):
        at = pa.array(at)
        yield pa.RecordBatch.from_arrays([*[c.take(at) for c in columns], terms.take(pa.array(number)), pa.array(counts, pa.int64())],
                                         names=[*keys, "term", "tf"])


#: Rows (site, term, df) that a task adds up before it hands them on.
PAGES_HELD = 1 << 20


def pages_counted(batches: Iterable[pa.RecordBatch], stopwords) -> Iterator[pa.RecordBatch]:
    """(site, term, df) of rows (site, doc_key, text), as ``counts_by_page``:
    the pages of a site with a term, added up as far as PAGES_HELD allows."""
    held, n = [], 0

    def added():
        t = pa.concat_tables(held).group_by(["site", "term"]).aggregate([("df", "sum")])
        return t.rename_columns({"df_sum": "df"}).select(["site", "term", "df"])

    for (sites, _), at, terms, number, _ in counts_by_page(batches, 2, stopwords):
        sites = sites.dictionary_encode(null_encoding="encode")
        of_site = sites.indices.to_numpy().astype(np.int64)
        pair, df = np.unique(of_site[at] * len(terms) + number, return_counts=True)
        held.append(pa.table([sites.dictionary.take(pa.array(pair // len(terms))), terms.take(pa.array(pair % len(terms))),
                              pa.array(df, pa.int64())], names=["site", "term", "df"]))
        n += len(pair)
        if n >= PAGES_HELD:
            held = [added()]
            n = len(held[0])
            if n >= PAGES_HELD // 2:
                yield from held[0].combine_chunks().to_batches()
                held, n = [], 0
    if held:
        yield from added().combine_chunks().to_batches()


def merge(tf: dict[str, int], terms: pa.Array, number: np.ndarray, counts: np.ndarray) -> None:
    """Add the counts of some terms to ``tf``."""
    for t, n in zip(terms.take(pa.array(number)).to_pylist(), counts.tolist(), strict=True):
        tf[t] = tf.get(t, 0) + n


def term_counts(docs: DataFrame, stopwords="nltk", text_col: str = "text", keys=("site", "doc_key"),
                once: bool = True) -> DataFrame:
    """(keys..., term, tf) of ``index_terms``, counted page by page as the rows
    stream through a task: nothing but one page's counts is held.  ``once``:
    one row a page and term, also where a page's text comes in several rows;
    for that rows are dealt and sorted by page."""
    rows = docs.select(*keys, F.col(text_col).alias("text"))
    if once:
        rows = rows.repartition(*keys).sortWithinPartitions(*keys)
    schema = StructType([*rows.select(*keys).schema.fields, StructField("term", StringType()), StructField("tf", LongType())])
    names, words = tuple(keys), sendable(stopwords)
    return rows.mapInArrow(lambda batches: counted(batches, names, words), schema)


def sendable(stopwords):
    return stopwords if stopwords is None or isinstance(stopwords, str) else list(stopwords)


def term_pages(docs: DataFrame, stopwords="nltk", text_col: str = "text") -> DataFrame:
    """(site, term, df): pages of a site with a term, to be summed up.  Pages
    are those of ``term_counts``; each task counts its own, so that a row stands
    for many postings and no posting leaves the task."""
    rows = docs.select("site", "doc_key", F.col(text_col).alias("text"))
    rows = rows.repartition("site", "doc_key").sortWithinPartitions("site", "doc_key")
    schema = StructType([rows.schema["site"], StructField("term", StringType()), StructField("df", LongType())])
    words = sendable(stopwords)
    return rows.mapInArrow(lambda batches: pages_counted(batches, words), schema)


def page_forms(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(keys..., e) of postings (keys..., term, tf) in which those of a page
    follow each other; e: its terms by falling tf, then term.  One page stays
    open from batch to batch."""
    held = []

    def forms():
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        keys = t.columns[:width]
        pages = pages_of(keys)
        order = pc.sort_indices(pa.table({"page": pages, "term": t.column(width), "tf": t.column(width + 1)}),
                                [("page", "ascending"), ("tf", "descending"), ("term", "ascending")], null_placement="at_start")
        entries = pa.StructArray.from_arrays([t.column(width).take(order), t.column(width + 1).take(order)], names=["term", "tf"])
        first = np.flatnonzero(np.r_[True, np.diff(pages) > 0])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(pages)], pa.int32()), entries)
        return pa.RecordBatch.from_arrays([*[c.take(pa.array(first)) for c in keys], lists], names=[*t.schema.names[:width], "e"])

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[-1].column(i)[-1].as_py() != batch.column(i)[0].as_py() for i in range(width)):
            yield forms()
            held = []
        pages = pages_of(batch.columns[:width])
        cut = int(np.searchsorted(pages, pages[-1]))        # where the last page starts
        if cut:
            held.append(batch.slice(0, cut))
            yield forms()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield forms()


def page_entries(postings: DataFrame, keys=("site", "doc_key")) -> DataFrame:
    """(keys..., e array<struct<term, tf>>) of postings of which those of a
    page follow each other in a task; see ``page_forms``."""
    rows = postings.select(*keys, "term", "tf")
    e = ArrayType(StructType([rows.schema["term"], rows.schema["tf"]]))
    schema, width = StructType([*rows.select(*keys).schema.fields, StructField("e", e)]), len(keys)
    return rows.mapInArrow(lambda batches: page_forms(batches, width), schema)


def query_terms(queries: DataFrame, irregular: bool = True) -> DataFrame:
    """(query_id, site, term, qtf) for a query table (query_id, site, query).

    ``irregular=True`` follows the web search route (stems lower-cased tokens,
    so the stemmer's irregular forms apply); ``False`` follows the offline
    ranking, which stems the upper-cased token."""
    toks = (queries.select("query_id", "site",
                           F.explode(F.split(collapse_ws(F.upper(F.col("query"))), " ")).alias("tok"))
                   .where(F.col("tok") != "")
                   .select("query_id", "site", F.lower(F.col("tok")).alias("tok")))
    stemmed = with_stem(toks, "tok", "term", irregular=irregular)
    return stemmed.groupBy("query_id", "site", "term").agg(F.count(F.lit(1)).alias("qtf"))
