"""Line dedup by distinct-site spread.

A line that many sites share is boilerplate.  How many sites hold a line is
sketched: one HyperLogLog sketch of the sites per line hash, built in each
task and merged by the grouped aggregation.  Lines whose estimate is within
the sketch's error of the threshold get an exact distinct count; the rest are
decided by the sketch.  Of each boilerplate line the first occurrence in the
corpus stays (smallest doc_id, then line number), so that nothing is lost
altogether; the others are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm import common

MIN_SITES = 10
MIN_WORDS = 3
LG_K = 10             # 1024 registers: standard error below 3.3 %
BAND = 0.25           # estimates within 25 % of the threshold (over 7 errors) are counted exactly
SPACE = r"[\x20\x09-\x0D]+"


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def line_rows(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc, site, i, line): the lines with ``min_words`` words or more, as
    128-bit hashes of the line without outer white space."""
    rows = docs.select("doc", "site", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("i", "l"))
    rows = rows.select("doc", "site", "i", trimmed(F.col("l")).alias("l"))
    enough = F.col("l").rlike(r"^[^\x20\x09-\x0D]+([\x20\x09-\x0D]+[^\x20\x09-\x0D]+){%d}" % (min_words - 1))
    return rows.where(enough).select("doc", "site", "i", line_hash(F.col("l")).alias("line"))


def line_hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(1)).alias("b"))


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """(line, first): lines of ``min_sites`` distinct sites or more, with the
    first occurrence.  ``lines`` are stored rows (doc, site, i, line)."""
    spread = lines.groupBy("line").agg(
        F.count("site").alias("n"), F.min(F.struct("doc", "i")).alias("first"))
    # a line needs as many occurrences as sites: most lines end here, unsketched
    often = common.store(spread.where(F.col("n") >= min_sites).select("line", "first"), "line-often")
    held = lines.join(often, "line", "left_semi").select("line", "site")
    est = held.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
    est = common.store(est, "line-sites")
    near = est.where(F.abs(F.col("sites") - min_sites) <= F.lit(max(1.0, BAND * min_sites))).select("line")
    exact = (held.join(near, "line", "left_semi").groupBy("line")
             .agg(F.countDistinct("site").alias("exact")))
    out = est.join(exact, "line", "left").where(F.coalesce("exact", "sites") >= min_sites).select("line")
    return common.store(often.join(out, "line", "left_semi"), "line-boilerplate")


def remove_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS,
                 carry: list[str] | None = None) -> DataFrame:
    """(__row, text, n_lines, n_removed) for every row of ``docs`` (doc_id,
    text, source and any others; ``__row`` holds the row or its ``carry``
    columns).

    Sites are the values of ``source``; null is no site.  Null texts stay null
    with no lines; empty texts have one empty line; lines of fewer than
    ``min_words`` words are never removed.  Rows with the same doc_id and text
    are one document: they are told apart by (doc_id, MD5 of the text), and
    keep the same lines.  A null doc_id is ordered before the others.
    """
    key = F.struct(F.col("doc_id").alias("id"), F.md5(common.utf8(F.col("text"))).alias("h"))
    keyed = docs.select(key.alias("doc"), F.col("source").cast("string").alias("site"), "text")
    lines = common.store(line_rows(keyed, min_words), "lines")
    bad = boilerplate(lines, min_sites)
    drop = (lines.join(bad, "line").where(~F.col("first").eqNullSafe(F.struct("doc", "i")))
            .groupBy("doc").agg(F.collect_set("i").alias("drop")))      # bounded by the document's lines
    drop = common.store(drop.select(F.col("doc.h").alias("h"), F.col("doc.id").alias("id"),
                                    F.col("drop")), "line-drop")
    rows = docs.select(common.pack(docs.select(carry or docs.columns)), F.col("text"), key.alias("k"))
    out = rows.join(drop, (rows["k.h"] == drop["h"]) & rows["k.id"].eqNullSafe(drop["id"]), "left")
    out = out.withColumn("parts", F.split("text", "\n", -1))
    parts = F.col("parts")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("drop"))      # in order
    kept = F.transform(left, lambda i: F.get("parts", i))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long")
    cut = F.col("drop").isNotNull()
    return out.select(common.ROW, F.when(cut, F.array_join(kept, "\n")).otherwise(F.col("text")).alias("text"),
                      n.alias("n_lines"), F.when(cut, F.size("drop")).otherwise(0).cast("long").alias("n_removed"))


def dedup(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with boilerplate lines cut out of ``text`` (and ``n_chars``
    counted anew where a line went, if there is such a column).  Documents of
    which no word is left go; documents that lose nothing stay as they are."""
    r = remove_lines(docs, min_sites, min_words)
    r = r.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    row = F.col(common.ROW).withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
                            .otherwise(F.col(f"{common.ROW}.n_chars")))
    return common.unpack(r.select(row.alias(common.ROW)))
