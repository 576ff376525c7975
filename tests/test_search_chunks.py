"""Searches that score pages by the chunk: equal to a plain sum, at any size
of the chunks, and no row for each page that a query's terms meet."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import search

K = 3


def table(spark):
    r = random.Random(4)
    words = ["t%d" % i for i in range(30)]
    posts = {}
    for site, n in (("a", 60), ("b", 7)):
        for d in range(n):
            for w in r.sample(words, r.randrange(1, 20)):
                posts[site, "%s%03d" % (site, d), w] = r.randrange(1, 4) * (1 if d % 10 else 20)
    posts.update({("a", "tie%d" % i, "same"): 2 for i in range(9)})
    df = {}
    for site, _, w in posts:
        df[site, w] = df.get((site, w), 0) + 1
    n = {"a": 69, "b": 7}
    queries = [(q, site, w, r.randrange(1, 3)) for q in range(20) for site in (("a", "b") if q % 3 else ("a",))
               for w in r.sample(words, r.randrange(1, 9))] + [(90, "a", "same", 1), (91, "a", "unknown", 1)]
    index = {"postings": spark.createDataFrame([(*key, tf) for key, tf in posts.items()], "site string, doc_key string, term string, tf bigint"),
             "doc_freq": spark.createDataFrame([(*key, x) for key, x in df.items()], "site string, term string, df bigint"),
             "doc_count": spark.createDataFrame(list(n.items()), "site string, n bigint")}
    scores = {}
    for q, site, w, times in queries:
        for (s, d, x), tf in posts.items():
            if (s, x) == (site, w):
                scores[q, site, d] = scores.get((q, site, d), 0) + tf * times * n[site] / df[site, w]
    best = sorted((q, -round(c, 6), d) for (q, _, d), c in scores.items())
    best = [x for i, x in enumerate(best) if i < K or best[i - K][0] != x[0]]
    return index, spark.createDataFrame(queries, "query_id bigint, site string, term string, qtf bigint"), best, len(scores)


@pytest.mark.parametrize("pages, groups", [(4096, 1 << 16), (5, 4)])
def test_best_scores_by_chunks(spark, monkeypatch, pages, groups):
    monkeypatch.setattr(search, "CHUNK_PAGES", pages)
    monkeypatch.setattr(search, "GROUP_QUERIES", groups)
    stored = {}

    def kept(df, name, real=search.materialize):
        stored[name] = real(df, name)
        return stored[name]
    monkeypatch.setattr(search, "materialize", kept)
    index, terms, best, met = table(spark)
    got = sorted((r["query_id"], -r["score"], r["doc_key"]) for r in search.best_scores(index, terms, K).collect())
    got = [x for i, x in enumerate(got) if i < K or got[i - K][0] != x[0]]
    assert [x[::2] for x in got] == [x[::2] for x in best]
    assert [x[1] for x in got] == pytest.approx([x[1] for x in best], abs=2e-6)
    # what a chunk gives for a query is bounded by k, not by its pages
    chunks = stored["search-chunks"].groupBy("site").agg(F.countDistinct("size", "part").alias("c"))
    most = K * stored["search-asked"].join(chunks, "site").agg(F.sum("c")).first()[0]
    assert stored["search-met"].count() <= min(most, met)
    assert pages < 4096 or stored["search-met"].count() < met / 4
