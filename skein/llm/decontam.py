"""Benchmark decontamination: a broadcast hash set of the benchmark's n-grams,
and one pass over every window of the training text.

A window can only be in the set if it holds, at the right place, the longest
word of some n-gram; so each word is first looked up in a broadcast gate of
those words, and only windows that pass are hashed and looked up in the set
(map-side hash joins: no shuffle of the corpus).  Windows that hit are verified
word by word, so a collision cannot mark a clean text.  All built-in
expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm import common

N = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Windows of the benchmark that are broadcast at most (about 200 bytes each);
#: a larger set is joined with a shuffle.
MAX_BROADCAST = 500_000


def words(text: Column) -> Column:
    """The words of a text as they stand; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def word_hash(w: Column) -> Column:
    """Equal for words that are equal once A-Z are lower-cased (and for some
    more, which the check of the hits tells apart): lower() has a fast path
    for ASCII, translate() does not."""
    return F.xxhash64(F.lower(w))


def phrase(w: Column) -> Column:
    """Words with A-Z lower-cased, joined; no word holds a space."""
    return common.ascii_lower(F.array_join(w, " "))


def ngrams(benchmark: DataFrame, n: int = N) -> DataFrame:
    """Distinct windows (len, gram string, hash, gate, off, items
    array<bigint>); an item of fewer than ``n`` words, but not none, is one
    window.  ``gate`` is the hash of its longest word, ``off`` its place."""
    w = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("len", F.least(F.size("w"), F.lit(n)))
    grams = w.select("item_id", "len", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("w") - F.col("len") + 1),
        lambda i: F.slice(F.col("w"), i, F.col("len")))).alias("g"))
    grams = grams.groupBy("len", phrase(F.col("g")).alias("gram")).agg(
        F.array_sort(F.collect_set("item_id")).alias("items"))
    each = F.transform(F.split("gram", " "), lambda x, i: F.struct(F.length(x).alias("n"), word_hash(x).alias("gate"), i.alias("off")))
    best = F.array_max(each)
    return grams.select("len", "gram", F.xxhash64("gram").alias("hash"), best["gate"].alias("gate"),
                        best["off"].alias("off"), "items")


def hits(docs: DataFrame, benchmark: DataFrame, keys: list[str], n: int = N) -> DataFrame:
    """(keys, w0, len, items): every window of a document that is a window of
    the benchmark, at word ``w0``."""
    grams = common.store(ngrams(benchmark, n), "decontam-set")
    small = grams.count() <= MAX_BROADCAST
    send = lambda df: F.broadcast(df) if small else df
    gates = grams.select("gate", "off", "len").distinct()
    each = docs.select(*keys, words(F.col("text")).alias("w")).select(*keys, "w", F.posexplode("w").alias("i", "word"))
    near = each.withColumn("gate", word_hash(F.col("word"))).join(send(gates), "gate")
    near = near.withColumn("w0", F.col("i") - F.col("off")).where("w0 >= 0 and w0 + len <= size(w)")
    near = near.select(*keys, "w0", "len", phrase(F.slice(
        "w", F.greatest(F.col("w0") + 1, F.lit(1)), F.col("len"))).alias("text"))
    near = near.withColumn("hash", F.xxhash64("text"))
    found = near.join(send(grams.select("hash", "gram", F.col("len").alias("k"), "items")), "hash")
    return found.where("gram = text and k = len").select(*keys, "w0", "len", "items")


def text_key(text: Column) -> Column:
    return F.md5(common.utf8(text))


def runs(at: Column) -> Column:
    """The runs (s, e) of neighbouring numbers in a sorted column ``at``: each
    number is looked at beside the one before and the one after."""
    first = F.filter(at, lambda p, i: (i == 0) | (F.get(at, i - 1) < p - 1))
    last = F.filter(at, lambda p, i: (i == F.size(at) - 1) | (F.get(at, i + 1) > p + 1))
    return F.zip_with(first, last, lambda s, e: F.struct(s.alias("s"), (e + 1).alias("e")))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N,
                  carry: list[str] | None = None) -> DataFrame:
    """(__row, n_words, n_hit, items, spans, contaminated) for every row;
    ``__row`` holds the row, or its ``carry`` columns only.

    Rows with the same text share one verdict (the key is the text's MD5), so
    null or repeated ids do no harm.  Null, empty and wordless texts have no
    words and no hits.  ``spans`` are the merged hit runs as (first word, after
    last).  An empty benchmark or table gives no hits.  Very long texts, and
    texts with very many hits, take time in proportion.
    """
    keyed = docs.select("text", text_key(F.col("text")).alias("key"))
    found = hits(keyed, benchmark, ["key"], n)
    # per text: the words covered (bounded by the text), in order, and the items
    covered = F.flatten(F.transform(F.collect_set(F.struct("w0", "len")),
                                    lambda x: F.sequence(x["w0"], x["w0"] + x["len"] - 1)))
    per = found.groupBy("key").agg(
        F.array_sort(F.array_distinct(covered)).alias("at"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    per = common.store(per, "decontam-hits")
    # stored again: the join then knows its true size, and texts are not shuffled to it
    per = common.store(per.select("key", "items", runs(F.col("at")).alias("spans")), "decontam-spans")
    rows = docs.select(common.pack(docs.select(carry or docs.columns)), text_key(F.col("text")).alias("key"),
                       F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = rows.join(per, "key", "left")
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"]),
                       F.lit(0).cast("long"))
    none = F.expr("cast(array() as array<bigint>)")
    return out.select(common.ROW, "n_words", n_hit.alias("n_hit"),
                      F.coalesce("items", none).alias("items"), "spans", (n_hit > 0).alias("contaminated"))


def with_spans_removed(df: DataFrame, text: Column, spans: str, name: str) -> DataFrame:
    """``df`` with ``name``: ``text`` without the words of ``spans`` and what
    stands between them.  Pieces to leave out are a set of numbers, so the
    time is linear in the text."""
    pieces = F.regexp_extract_all(text, F.lit(r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1))
    lead = F.when(text.rlike(r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), 1).otherwise(0)
    # word k is piece 2k + lead; a run of words s..e-1 takes the pieces 2s+lead .. 2(e-1)+lead
    gone = F.flatten(F.transform(spans, lambda x: F.sequence(x["s"] * 2, (x["e"] - 1) * 2)))
    # only hit texts are cut up; their pieces stand in a column of their own
    hit = F.size(F.coalesce(spans, F.expr("cast(array() as array<struct<s:int,e:int>>)"))) > 0
    cut = df.withColumns({"__pieces": F.when(hit, pieces), "__gone": F.when(hit, F.transform(gone, lambda i: i + lead))})
    left = F.array_except(F.sequence(F.lit(0), F.size("__pieces") - 1), "__gone")
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("__pieces"), i)), "")
    return cut.withColumn(name, F.when(F.col("__pieces").isNotNull(), kept).otherwise(text)).drop("__pieces", "__gone")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = N) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) with
    the hit words cut out of ``text``; other columns stay as they are."""
    c = contamination(docs, benchmark, n)
    if remove == "documents":
        return common.unpack(c.where(~F.col("contaminated")).select(common.ROW))
    if remove != "spans":
        raise ValueError(remove)
    c = with_spans_removed(c, F.col(f"{common.ROW}.text"), "spans", "__rest")
    return common.unpack(c.select(F.col(common.ROW).withField("text", F.col("__rest")).alias(common.ROW)))
