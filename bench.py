"""Benchmark the headline jobs; prints ONE JSON line.

  BENCH_SF_DIR  input tables (default /root/testdata/sf0.1)
  BENCH_CPUS    local[N] (default 8)

Jobs (warm: every job first runs once on sf0.01, enough input for the JVM to
compile the large generated methods, so JIT and code generation are paid
outside the timings, as on a long-running cluster executor):
  index_build   documents -> docs, postings, doc_freq, doc_count written as
                Parquet (one site spanning all documents)
  search_batch  every benchmark text as a query against the stored index
                (one site spanning all documents), top 10 each
  page_text     pages -> visible text, written
  new_links     pages -> resolved, in-scope, deduplicated links, written
  crawl_round   one crawl round over the page corpus (frontier = all page
                URLs), state written
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from skein.functions.text import page_text  # noqa: E402
from skein.operators import frontier as fr  # noqa: E402
from skein.operators import links as lk  # noqa: E402
from skein.operators import search  # noqa: E402
from skein.plans import catalog  # noqa: E402
from skein.session import get_spark, scratch_path  # noqa: E402
from skein.sources import index_store, tables  # noqa: E402


def jobs(spark, sf_dir):
    out = {}

    def index_build():
        root = scratch_path(spark, "bench-index")
        index_store.build_and_store(catalog.docs_one_site(spark, sf_dir), root)
        out["root"] = root

    def search_batch():
        idx = index_store.read_index(spark, out["root"])
        res = search.search_batch(idx, catalog.benchmark_queries(spark, sf_dir), k=10)
        out["n_results"] = res.count()

    def page_text_job():
        p = tables.pages(spark, sf_dir)
        p.select("page_id", page_text(F.col("html")).alias("text")) \
         .write.mode("overwrite").parquet(scratch_path(spark, "bench-text"))

    def new_links_job():
        lk.new_links(catalog.page_sites(spark, sf_dir), catalog.crawled_probe(spark, sf_dir),
                     catalog.LINK_PATTERN).write.mode("overwrite").parquet(scratch_path(spark, "bench-links"))

    def crawl_round_job():
        p = catalog.page_sites(spark, sf_dir)
        frontier = p.select("site", "url", F.lit(0).cast("int").alias("round"))
        base = scratch_path(spark, "bench-crawl")
        r = fr.crawl_round(frontier, fr.empty(spark), tables.pages(spark, sf_dir), 100, 1,
                           persist=lambda name, df: fr.save_state(df, os.path.join(base, name)))
        fr.save_state(r["status"], os.path.join(base, "status"))

    return {"index_build": index_build, "search_batch": search_batch,
            "page_text": page_text_job, "new_links": new_links_job,
            "crawl_round": crawl_round_job}, out


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(f"local[{cpus}]", app="skein-bench", shuffle_partitions=cpus)
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.01")
    if os.path.isdir(warm_dir):
        warm, _ = jobs(spark, warm_dir)
        for fn in warm.values():
            fn()
    timed, state = jobs(spark, sf_dir)
    secs = {}
    for name, fn in timed.items():
        t0 = time.perf_counter()
        fn()
        secs[name] = round(time.perf_counter() - t0, 3)
    n_queries = spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet")).count()
    total = round(sum(secs.values()), 3)
    print(json.dumps({
        "metric": "total_sec_headline_jobs", "value": total, "unit": "sec",
        "queries": secs, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "search_queries_per_sec": round(n_queries / secs["search_batch"], 2),
        "config": {"master": f"local[{cpus}]", "state": "warm"},
    }))


if __name__ == "__main__":
    main()
