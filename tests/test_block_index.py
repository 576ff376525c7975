"""The stored index: bucketed layout, bounds, and exact pruned top-k."""
import glob
import json
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from skein.operators import index as ix
from skein.operators import pruned, search
from skein.plans import catalog
from skein.session import scratch_path
from skein.sources import index_store
from test_plans import plan_of

LAYOUT = (4, 8)


def corpus(spark, n=600, sites=3):
    r = random.Random(11)
    vocab = ["w" + "".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(150)]
    rows = []
    for i in range(n):
        words = [vocab[min(int(r.expovariate(.05)), 149)] for _ in range(r.randrange(0, 40))]
        if i % 97 == 5:
            words += ["zebra"] * r.randrange(1, 30)
        rows.append((f"s{min(int(r.expovariate(1)), sites - 1)}", f"{i:04d}", f"u{i}", " ".join(words)))
    qs = [" ".join(r.choice(vocab[:60]) for _ in range(r.randrange(1, 6))) for _ in range(25)]
    qs += ["zebra", "zebra " + vocab[0], "nothing here", "", vocab[0] + " " + vocab[0] + " zebra"]
    queries = [(i, f"s{i % sites}", q) for i, q in enumerate(qs)] + [(900, "s0", "zebra"), (901, "unknown", "zebra")]
    return (spark.createDataFrame(rows, "site string, doc_key string, url string, text string"),
            spark.createDataFrame(queries, "query_id bigint, site string, query string"))


@pytest.fixture(scope="module")
def stored(spark):
    docs, queries = corpus(spark)
    root = scratch_path(spark, "test-blocks")
    block, index_store.BLOCK_DOCS = index_store.BLOCK_DOCS, 8
    index_store.with_block.__defaults__ = (8,)
    try:
        index = index_store.build_and_store(docs, root, stopwords=None, layout=LAYOUT)
    finally:
        index_store.BLOCK_DOCS = block
        index_store.with_block.__defaults__ = (block,)
    return root, index, ix.build_index(docs, stopwords=None), queries


def test_stored_tables_equal_the_built(stored):
    _, index, built, _ = stored
    for name in ("docs", "postings", "doc_freq", "doc_count"):
        cols = built[name].columns
        assert sorted(map(tuple, index[name].select(*cols).collect())) == sorted(map(tuple, built[name].collect())), name
    b = index["bounds"].groupBy("site", "term").agg(F.max("max_tf").alias("m"), F.sum("n").alias("n"))
    want = built["postings"].groupBy("site", "term").agg(F.max("tf").alias("m"), F.count("*").alias("n"))
    assert b.exceptAll(want).count() == 0 and want.exceptAll(b).count() == 0
    blocks = index["bounds"].groupBy("site").agg(F.countDistinct("block").alias("n")).collect()
    assert max(r["n"] for r in blocks) > 20


@pytest.mark.parametrize("k", [1, 3, 10, 400])
def test_pruned_equals_full_scoring(stored, k):
    _, index, built, queries = stored
    key = lambda df: sorted(tuple(r) for r in df.collect())
    full = key(search.search_batch(built, queries, k))
    assert key(pruned.search_batch(index, queries, k)) == full
    assert key(search.search_batch(index, queries, k)) == full


def test_pruned_single_query(stored):
    _, index, built, _ = stored
    want = [tuple(r) for r in search.search_topk(built, "s0", "zebra wabc", 5).orderBy("rank").collect()]
    assert [tuple(r) for r in pruned.search_topk(index, "s0", "zebra wabc", 5).orderBy("rank").collect()] == want
    ans = search.search_answer(built, "s0", "zebra", 5).orderBy("rank").collect()
    assert pruned.search_answer(index, "s0", "zebra", 5).orderBy("rank").collect() == ans


def test_blocks_are_left_out(stored):
    """Blocks below the k-th score are not among the candidates."""
    _, index, _, _ = stored
    spark = index["docs"].sparkSession
    q = search.single_query("s0", "zebra", spark)
    wide = spark.createDataFrame([(0, "s0", "zebra " + r["term"]) for r in index["doc_freq"].where(
        "site = 's0'").orderBy(F.desc("df")).limit(1).collect()], "query_id bigint, site string, query string")
    qt = search.with_folders(index, search.query_terms(wide))
    every = pruned.block_bounds(index, search.weighted_terms(index, qt))
    pages = pruned.candidate_scores(index, wide, 1)
    matched = search.score_candidates(index, wide, None)
    assert pages.count() < matched.count() and every.count() > 20
    assert pruned.candidate_scores(index, q, 1).count() >= 1


def test_files_are_bounded_by_the_buckets(stored):
    root, _, _, _ = stored
    for name, folders in (("postings", LAYOUT[0] * LAYOUT[1]), ("doc_count", LAYOUT[0])):
        files = glob.glob(os.path.join(root, name, "**", "*.parquet"), recursive=True)
        assert 0 < len(files) <= folders + 8


def test_folders_are_pruned_from_the_query_side(spark, stored):
    _, index, _, queries = stored
    qt = search.query_side(index, search.with_folders(index, search.query_terms(queries)))
    qw = search.query_side(index, search.weighted_terms(index, qt))
    for df in (search.search_batch(index, queries, 5), pruned.block_bounds(index, qw)):
        scans = [x for x in plan_of(df).split("\n") if "PartitionFilters" in x and "dynamicpruning" in x]
        assert any("sb#" in x and "tb#" in x for x in scans), plan_of(df)
    one = index_store.read_table(spark, stored[0], "postings", "s1")
    assert "PartitionFilters: [isnotnull(sb" in plan_of(one)


SCAN = r"""
import sys
from skein.session import get_spark
from skein.sources import index_store
from skein.operators import pruned, search
root, log, kind, query = sys.argv[1:]
spark = get_spark("local[2]", shuffle_partitions=2, extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": "file:" + log,
                  "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"})
index = index_store.read_index(spark, root)
(pruned if kind == "pruned" else search).search_topk(index, "all", query, 3).collect()
spark.stop()
"""


def postings_rows(log):
    """Rows that scans of postings gave, from the event log."""
    names, rows = {}, 0
    for f in glob.glob(os.path.join(log, "*")):
        for line in open(f):
            e = json.loads(line)
            plan = e.get("sparkPlanInfo")
            todo = [plan] if plan else []
            while todo:
                p = todo.pop()
                todo += p["children"]
                if p["nodeName"].startswith("Scan parquet") and "/postings" in json.dumps(p.get("metadata", {})) + p["simpleString"]:
                    names.update({m["accumulatorId"]: 1 for m in p["metrics"] if m["name"] == "number of output rows"})
            if e["Event"] == "SparkListenerTaskEnd":
                for a in e["Task Info"]["Accumulables"]:
                    if a["ID"] in names:
                        rows += int(a["Update"])
    return rows


def test_fewer_postings_are_read(spark, tmp_path):
    """One query on a stored index: rows of postings read, by the event log."""
    root = scratch_path(spark, "test-read")
    index = index_store.build_and_store(catalog.docs_one_site(spark, SF_SMALL), root, stopwords=None)
    total, rows = index["postings"].count(), {}
    for kind in ("pruned", "search"):
        log = tmp_path / kind
        log.mkdir()
        env = {**os.environ, "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
        subprocess.run([sys.executable, "-c", SCAN, root, str(log), kind, "the report"], check=True, env=env, timeout=300,
                       capture_output=True)
        rows[kind] = postings_rows(str(log))
    print(total, rows)
    assert 0 < rows["pruned"] < rows["search"] < total / 2
