"""Quality rules with adaptive thresholds.

Per document the signals below are measured; per (lang, source) group each
signal goes into a mergeable quantile sketch, and the group's thresholds are
read from it: median plus or minus ``FENCE`` times the spread between median
and outer decile.  No signal has a fixed cutoff; only the least width of a
fence is a parameter, since the spread of a clean signal is often zero.

The sketch is a log-linear histogram (64 buckets per power of two, so a
quantile is within 1/64 of the true one) held as rows (group, signal, bucket,
count).  Merging is addition, so the result does not depend on partitioning
or on the order of merges, a hot group is pre-aggregated in every task before
the shuffle, and small groups fall back on the merged sketch of their
language, then of the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skein.llm import common

MIN_WORDS = 10        # fewer words fail
MAX_REPEAT_PCT = 20   # more words in repeated windows fail
WINDOW = 5
FENCE = 6             # fence half-width in decile spreads
MIN_GROUP = 50        # documents a sketch needs, else the wider group's is used
SUB_BITS = 6          # 64 buckets per power of two

# signal -> least half-width of its fence (signals are integers, see SIGNALS)
SLACK = {"symbols": 1000, "length": 500, "dups": 5000}
TWO_SIDED = ("length",)

MEASURES = pa.struct([(n, pa.int64()) for n in (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")])
MEASURES_DDL = ("struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,"
                "n_dup_lines:bigint,n_repeat_words:bigint,n_lines:bigint>")
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_SPACE = np.frombuffer(b"\x20\x09\x0a\x0b\x0c\x0d", np.uint8)
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False      # continuation bytes start no code point
_LEAD[_SPACE] = False


def _repeated(words: list[bytes], n: int = WINDOW) -> int:
    """Words inside an n-word window that is found twice or more."""
    if len(words) <= n:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    key, base = a, len(ids)
    for i in range(1, n):
        if base * len(ids) >= 1 << 62:       # rank the prefixes anew, so that keys stay exact
            _, key = np.unique(key, return_inverse=True)
            base = int(key.max()) + 1
        key = key[:-1] * len(ids) + a[i:]
        base *= len(ids)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(text: bytes) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines)
    of one whole text in UTF-8.  bytes.split() splits on exactly the six
    white-space bytes 20 and 09-0D."""
    words = text.split()
    if not words:
        sym = np.bincount(np.frombuffer(text, np.uint8), minlength=256)[_SYMBOLS].sum()
        return 0, 0, int(sym), 0, 0, 0
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (len(words), int(count[_LEAD].sum()), int(count[_SYMBOLS].sum()),
            len(lines) - len(set(lines)), _repeated(words), len(lines))


def measures(text: Column) -> Column:
    """The measures of a text column, as a struct; null counts as no text."""
    @F.arrow_udf(MEASURES_DDL)
    def udf(texts: pa.Array) -> pa.Array:
        cols = zip(*[measure(x.as_buffer().to_pybytes()) for x in texts]) if len(texts) else [[]] * 6
        return pa.StructArray.from_arrays([pa.array(list(c), pa.int64()) for c in cols],
                                          fields=list(MEASURES))
    return udf(common.utf8(text))


def base_failed(m: str) -> Column:
    return (F.col(f"{m}.n_words") < MIN_WORDS) | (
        100 * F.col(f"{m}.n_repeat_words") > MAX_REPEAT_PCT * F.col(f"{m}.n_words"))


def signals(m: str) -> dict[str, Column]:
    """Integer signals: symbols and characters per word, repeated lines per line."""
    per = lambda a, b, k: F.expr(f"cast({k} * {m}.{a} div greatest({m}.{b}, 1) as bigint)")
    return {"symbols": per("n_symbols", "n_words", 10000), "length": per("word_chars", "n_words", 1000),
            "dups": per("n_dup_lines", "n_lines", 10000)}


def bucket(v: Column) -> Column:
    """The least value of the bucket that holds integer ``v`` >= 0."""
    drop = F.greatest(F.length(F.bin(v)) - F.lit(SUB_BITS + 1), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop)


def sketches(measured: DataFrame, m: str) -> DataFrame:
    """Rows (lang, source, signal, bucket, n) of the documents that pass the
    base rules, with the merged sketches of each language (source null, level
    1) and of the corpus (level 2)."""
    sig = F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), bucket(v).alias("bucket"))
                              for k, v in signals(m).items()]))
    rows = (measured.where(~base_failed(m)).select("lang", "source", sig.alias("s"))
            .select("lang", "source", "s.*"))
    fine = rows.groupBy("lang", "source", "signal", "bucket").agg(F.count("*").alias("n"))
    fine = common.store(fine, "quality-sketch")
    lang = fine.groupBy("lang", "signal", "bucket").agg(F.sum("n").alias("n"))
    every = fine.groupBy("signal", "bucket").agg(F.sum("n").alias("n"))
    none = F.lit(None).cast("string")
    cols = ["level", "lang", "source", "signal", "bucket", "n"]
    return (fine.withColumn("level", F.lit(0)).select(cols)
            .union(lang.withColumns({"level": F.lit(1), "source": none}).select(cols))
            .union(every.withColumns({"level": F.lit(2), "lang": none, "source": none}).select(cols)))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(level, lang, source, n, <signal>_lo, <signal>_hi): one row a group."""
    by = W.partitionBy("level", "lang", "source", "signal")
    run = sketch.withColumn("upto", F.sum("n").over(by.orderBy("bucket"))).withColumn("all", F.sum("n").over(by))
    at = lambda k: F.min(F.when(F.col("upto") * 10 >= F.col("all") * k, F.col("bucket")))
    q = (run.groupBy("level", "lang", "source", "signal")
         .agg(at(1).alias("lo"), at(5).alias("mid"), at(9).alias("hi"), F.max("all").alias("n")))
    # the smaller of the two spreads: junk on one side must not widen the fence
    q = q.withColumn("spread", F.least(F.col("mid") - F.col("lo"), F.col("hi") - F.col("mid")) * FENCE)
    agg = [F.max("n").alias("n")]
    for s, slack in SLACK.items():
        w = F.greatest(F.col("spread"), F.lit(slack))
        lo = F.col("mid") - w if s in TWO_SIDED else F.lit(-1).cast("long")
        agg += [F.max(F.when(F.col("signal") == s, lo)).alias(f"{s}_lo"),
                F.max(F.when(F.col("signal") == s, F.col("mid") + w)).alias(f"{s}_hi")]
    return q.groupBy("level", "lang", "source").agg(*agg)


def judge(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """(__row, m, base_failed, kept): every row of ``docs`` (text, lang,
    source and any other columns); ``__row`` holds the row, or its ``carry``
    columns only.

    Texts that are null, empty or without words fail the base rules.  Null
    languages and sources are groups of their own.  Repeated rows are judged
    alike.  A group of which fewer than MIN_GROUP documents pass the base
    rules uses the thresholds of its language, then of the corpus; an empty
    table gives an empty result.
    """
    common.prepare(docs.sparkSession)
    one = docs.select(common.pack(docs.select(carry or docs.columns)),
                      F.col("lang").cast("string").alias("lang"),
                      F.col("source").cast("string").alias("source"), measures(F.col("text")).alias("m"))
    m = common.store(one, "quality-measures")
    t = common.store(thresholds(sketches(m, "m")), "quality-thresholds")
    fences = [f"{s}_{e}" for s in SLACK for e in ("lo", "hi")]
    # thresholds: a row a group; joined null-safe, so that Spark picks the side to send by its size
    out = m
    for level, keys in ((0, ["lang", "source"]), (1, ["lang"]), (2, [])):
        side = t.where((F.col("level") == level) & ((F.col("n") >= MIN_GROUP) | (F.col("level") == 2)))
        side = side.select(*[F.col(k).alias(f"k_{k}") for k in keys],
                           F.struct(*fences).alias(f"f{level}"))
        if keys:
            cond = F.lit(True)
            for k in keys:
                cond = cond & out[k].eqNullSafe(side[f"k_{k}"])
            out = out.join(side, cond, "left").drop(*[f"k_{k}" for k in keys])
        else:
            out = out.withColumn("f2", side.select("f2").scalar())
    inside = F.lit(True)
    fence = F.coalesce("f0", "f1", "f2")
    for s, v in signals("m").items():
        inside = inside & v.between(fence[f"{s}_lo"], fence[f"{s}_hi"])
    failed = base_failed("m")
    return out.select(common.ROW, "m", failed.alias("base_failed"),
                      (~failed & F.coalesce(inside, F.lit(True))).alias("kept"))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns."""
    return common.unpack(judge(docs).where("kept").select(common.ROW))
