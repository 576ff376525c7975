"""The numbered queries: each applies one operator to its whole table and
derives the digest columns from the operator's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import (bpe_codec, classifier, common, decontam, filter_audit, jaccard, line_dedup, quality, sharding,
                       suffix, token_count, url_filter, warc, whitening)

DOC = f"{common.ROW}.doc_id"


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    j = quality.judge(common.table(spark, sf_dir, "documents"), carry=["doc_id"])
    return j.select(DOC, *[F.col(f"m.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                     "n_repeat_words")], "base_failed", "kept")


def op2_url_filters(spark, sf_dir: str) -> DataFrame:
    p = common.table(spark, sf_dir, "pages")
    out = url_filter.filter_urls(p.select("page_id", "url"), blocked_hosts=url_filter.spam_hosts(p),
                                 blocked_pages=url_filter.thin_pages(p))
    return out.select(f"{common.ROW}.page_id", "host", "path", "rule", "verdict")


def op3_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    r = bpe_codec.round_trip(common.table(spark, sf_dir, "documents"), carry=["doc_id"])
    return r.select(DOC, "n_tokens", "ids_sha256", "decoded_sha256")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    c = decontam.contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"),
                               carry=["doc_id"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return c.select(DOC, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(ids.cast("binary"), 256).alias("items_sha256"), "contaminated")


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    r = line_dedup.remove_lines(common.table(spark, sf_dir, "documents"), carry=["doc_id"])
    return r.select(DOC, "n_lines", "n_removed", F.md5(common.utf8(F.col("text"))).alias("kept_md5"))


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    r = token_count.token_counts(common.table(spark, sf_dir, "documents"), carry=["doc_id"])
    return r.select(DOC, "n_bytes", "n_tokens", "over_limit")


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    r = classifier.classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"),
                            carry=["doc_id"])
    return r.select(DOC, "text_score", "meta_score", "score", "kept")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    r = suffix.remove_repeats(common.table(spark, sf_dir, "documents"), carry=["doc_id"])
    return r.select(DOC, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_warc(spark, sf_dir: str) -> DataFrame:
    r = warc.archive(common.table(spark, sf_dir, "pages")).where(F.col("record_type").isin("response", "revisit"))
    # what a response holds is measured anew; a revisit has the headers only
    held = F.col("payload")
    return r.select(F.col("record_id").cast("long").alias("page_id"),
                    F.coalesce(F.octet_length(held).cast("long"), F.col("payload_bytes")).alias("payload_bytes"),
                    F.coalesce(F.sha1(held.cast("binary")), F.col("payload_digest")).alias("payload_digest"),
                    "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    c = jaccard.components(common.table(spark, sf_dir, "documents"), n=3, percent=90)
    return c.select("doc_id", "n_shingles", "component_id")


def op11_sharding(spark, sf_dir: str) -> DataFrame:
    a = sharding.assign(common.table(spark, sf_dir, "documents"), shards=24, key="doc_id", carry=["doc_id"])
    return a.select(DOC, "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot", "grown_shard")


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return filter_audit.audit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    w = whitening.whiten(common.table(spark, sf_dir, "embeddings"), "embedding", k=16, carry=["vec_id"])
    return w.select(f"{common.ROW}.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_url_filters, op3_bpe_round_trip, op4_decontamination, op5_line_dedup,
    op6_token_counts, op7_quality_classifier, op8_suffix_dedup, op9_warc, op10_jaccard_join,
    op11_sharding, op12_filter_audit, op13_whitening)}
