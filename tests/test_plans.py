"""Plan shape checks: the scale properties the README promises."""
import contextlib
import io

from pyspark.sql import functions as F

from conftest import SF_SMALL
from skein.functions.stem import with_stem
from skein.operators import frontier as fr
from skein.operators import search
from skein.plans import catalog
from skein.session import scratch_path
from skein.sources import index_store


def plan_of(df, mode="formatted"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def test_search_plan_streams_postings_past_broadcast(spark):
    root = scratch_path(spark, "plan-index")
    index_store.build_and_store(catalog.docs_one_site(spark, SF_SMALL), root)
    idx = index_store.read_index(spark, root)
    p = plan_of(search.search_batch(idx, catalog.benchmark_queries(spark, SF_SMALL), k=10))
    assert "WindowGroupLimit" in p                       # partial top-k before the exchange
    assert "BroadcastHashJoin" in p
    assert "ReadSchema: struct<site:string,doc_key:string,term:string,tf:bigint>" in p   # pruned scan
    assert "PartitionFilters: [isnotnull(sb" in p and "dynamicpruning" in p     # folders of sites and terms


def test_frontier_batch_uses_group_limit(spark):
    p = catalog.page_sites(spark, SF_SMALL).select("site", "url", F.lit(0).alias("round"))
    assert "WindowGroupLimit" in plan_of(fr.frontier_batch(p, 5))


def test_filter_on_stem_keeps_plan_small(spark):
    words = spark.createDataFrame([("running",)], "word string")
    df = with_stem(words, "word", "term").where(F.col("term").isNotNull() & (F.col("term") != "x"))
    assert len(plan_of(df, "extended")) < 400_000
