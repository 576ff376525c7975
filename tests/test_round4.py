"""Rounds taken in stretches, counted terms, pages that can be among the best:
each against the plain way of doing it."""
import random

from pyspark.sql import functions as F

from skein.operators import analyze
from skein.operators import frontier as fr
from skein.operators import index as ix
from skein.operators import search
from skein.plans import crawl
from skein.session import scratch_path

WORDS = ["running", "Runs", "skies", "pony", "Straße", "hopping", "falling", "relational", "the", "x1", "of,", "yyes", "İxing"]


def round_by_round(spark, corpus, seeds, n, pattern, frontier):
    job = crawl.Crawl(corpus, seeds, n, pattern, frontier=frontier)
    while True:
        left = seeds.join(job.crawled.select("site", "url"), ["site", "url"], "left_anti")
        if fr.with_seeds(job.frontier, left).isEmpty():
            return job.result()
        job.round(left)


def test_stretches_are_the_same_rounds(spark):
    rnd = random.Random(3)
    pages = []
    for site, n in (("a", 30), ("b", 9), ("c", 3)):
        for i in range(n):
            to = "".join(f'<a href="/{rnd.randrange(n + 6)}">l</a>' for _ in range(2))
            pages.append((f"https://{site}/{i}", to))
    corpus = spark.createDataFrame(pages, "url string, html string")
    seeds = spark.createDataFrame([("a", "https://a/0"), ("b", "https://b/0"), ("c", "https://c/9"), ("d", "https://d/")],
                                  "site string, url string")
    known = [("a", f"https://a/{i}", i % 3) for i in range(5, 17)] + [("b", "https://b/1", 0)]
    frontier = spark.createDataFrame(known, "site string, url string, round int")
    want = round_by_round(spark, corpus, seeds, 3, "", frontier)
    steps, old = [], crawl.Stretches.step
    crawl.Stretches.step = lambda self: steps.append(1) or old(self)
    try:
        got = crawl.crawl_until_done(spark, corpus, seeds, 3, frontier=frontier)
    finally:
        crawl.Stretches.step = old
    assert got["rounds"] == want["rounds"]
    for name in ("crawled", "tried", "fetched", "status", "frontier"):
        assert sorted(map(tuple, got[name].select(want[name].columns).collect())) == sorted(map(tuple, want[name].collect())), name
    # every page known beforehand: the steps do not follow their number
    steps.clear()
    every = spark.createDataFrame([("a", f"https://a/{i}", 0) for i in range(120)], "site string, url string, round int")
    crawl.Stretches.step = lambda self: steps.append(1) or old(self)
    try:
        got = crawl.crawl_until_done(spark, corpus, seeds.where("site = 'a'"), 3, frontier=every)
    finally:
        crawl.Stretches.step = old
    assert got["rounds"] >= 40 and len(steps) <= 5


def test_seed_without_url_does_not_keep_a_crawl_going(spark):
    corpus = spark.createDataFrame([("https://a/0", "x")], "url string, html string")
    seeds = spark.createDataFrame([("a", "https://a/0"), (None, None)], "site string, url string")
    assert crawl.crawl_until_done(spark, corpus, seeds, 3)["rounds"] == 1


def test_counted_terms_are_those_of_the_column_expressions(spark):
    rnd = random.Random(5)
    rows = [("s" if i % 3 else None, str(i // 2), " ".join(rnd.choices(WORDS, k=i % 40)) if i % 7 else None) for i in range(90)]
    docs = spark.createDataFrame(rows, "site string, doc_key string, text string")
    for stopwords in ("nltk", None, ["poni"]):
        want = analyze.index_terms(docs, stopwords).groupBy("site", "doc_key", "term").agg(F.count("*").alias("tf"))
        got = ix.term_freq(docs, stopwords)
        key = lambda r: [str(x) for x in r]
        assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    # counted as the texts stream by: no aggregation holds a task's pages
    plan = ix.term_freq(docs)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "HashAggregate" not in plan


def test_queries_of_one_profile_are_answered_once(spark):
    rnd = random.Random(7)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    docs = [("s" if i % 4 else "t", f"d{i:03}", "", " ".join(rnd.choices(words, weights=[60 / (j + 1) for j in range(60)], k=30))) for i in range(200)]
    index = ix.build_index(spark.createDataFrame(docs, "site string, doc_key string, url string, text string"))
    asked = [(i, "s" if i % 2 else "t", " ".join(rnd.choices(words, k=rnd.randrange(1, 9)))) for i in range(30)]
    asked += [(100 + i, "s", "wba waa wca waa") for i in range(25)] + [(200, "s", "nothing"), (None, "t", "waa"), (201, None, "waa")]
    asked += [(202, "s", "wda"), (202, "t", "wea")]
    queries = spark.createDataFrame(asked, "query_id bigint, site string, query string")
    plain = search.best_of(search.score_candidates(index, queries, 5), index, 5)
    for bound in (1_000_000, 0):
        got = search.search_batch(index, queries, 5, max_broadcast_rows=bound)
        key = lambda r: [str(x) for x in r]
        assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)
    qt = search.query_terms(queries)
    n = search.profiles(queries, qt).where("query_id between 100 and 124").select("profile").distinct().count()
    assert n == 1
