from pyspark.sql import functions as F

from skein.operators import frontier as fr
from skein.plans.crawl import crawl, index_fetched
from skein.session import scratch_path

PAGES = [(1, "https://h/s", '<a href="/a">a</a><a href="/b">b</a>'),
         (2, "https://h/a", '<a href="/b">b</a><a href="/c">c</a>'),
         (3, "https://h/b", '<a href="/s">s</a>')]


def setup(spark):
    corpus = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    seeds = spark.createDataFrame([("h", "https://h/s")], "site string, url string")
    return corpus, seeds


def urls_of(df):
    return sorted(r.url.rsplit("/", 1)[1] for r in df.collect())


def test_f5_strict_rounds(spark, tmp_path):
    corpus, seeds = setup(spark)
    frontier, crawled = fr.empty(spark), fr.empty(spark)
    expect = [(["s"], ["s"], ["a", "b"], "1 crawled, 2 remaining, Stopped."),
              (["a", "b"], ["a", "b", "s"], ["c"], "3 crawled, 1 remaining, Stopped."),
              (["c"], ["a", "b", "c", "s"], [], "4 crawled, 0 remaining, Stopped.")]
    for r, (batch, crawled_after, frontier_after, status) in enumerate(expect, start=1):
        out = fr.crawl_round(frontier, crawled, corpus, 3, r, seeds=seeds)
        assert urls_of(out["batch"]) == batch
        assert urls_of(out["crawled"]) == crawled_after
        assert urls_of(out["frontier"]) == frontier_after
        assert out["status"].first().status == status
        # each round's state is written and read back, as the crawl job does,
        # so round r's plan does not nest rounds 1..r-1
        frontier = fr.save_state(out["frontier"], str(tmp_path / f"f{r}"))
        crawled = fr.save_state(out["crawled"], str(tmp_path / f"c{r}"))


def test_reference_rule_keeps_seed(spark):
    corpus, seeds = setup(spark)
    out = fr.crawl_round(fr.empty(spark), fr.empty(spark), corpus, 3, 1, seeds=seeds, strict=False)
    assert urls_of(out["frontier"]) == ["a", "b", "s"]


def test_failed_fetch_and_skipped_ending(spark):
    corpus, _ = setup(spark)
    frontier = spark.createDataFrame([("h", "https://h/s", 0), ("h", "https://h/x.pdf", 0),
                                      ("h", "https://h/zz", 0)], "site string, url string, round int")
    got = {r.url: r.fetched for r in fr.fetch(fr.frontier_batch(frontier, 10), corpus).collect()}
    assert got == {"https://h/s": True, "https://h/x.pdf": False, "https://h/zz": False}


def test_multi_round_crawl_and_index(spark):
    corpus, seeds = setup(spark)
    out = crawl(spark, corpus, seeds, rounds=3, n=3)
    st = {r["round"]: r.status for r in out["status"].collect()}
    assert st == {1: "1 crawled, 2 remaining, Stopped.", 2: "3 crawled, 1 remaining, Stopped.",
                  3: "4 crawled, 0 remaining, Stopped."}
    idx = index_fetched(out["fetched"])
    assert idx["doc_count"].first().n == 3
    # frontier and crawled never overlap under the strict rule
    assert out["frontier"].join(out["crawled"], ["site", "url"]).count() == 0


def test_crawl_state_files(spark, tmp_path):
    # One URL per line, trimmed, duplicates dropped; missing -> empty
    p = tmp_path / "crawled.txt"
    p.write_text("https://h/a\n  https://h/b \n\nhttps://h/a\n")
    got = fr.load_urls(spark, str(p), "h")
    assert sorted(r.url for r in got.collect()) == ["https://h/a", "https://h/b"]
    assert fr.load_urls(spark, str(tmp_path / "missing.txt"), "h").count() == 0
    fr.save_urls(got, str(tmp_path / "out"))
    back = fr.load_urls(spark, str(tmp_path / "out"), "h")
    assert sorted(r.url for r in back.collect()) == ["https://h/a", "https://h/b"]


def test_crawl_until_no_site_has_a_frontier(spark):
    from skein.plans.crawl import crawl_until_done
    from skein.sources.corpus import store_corpus
    pages = [(f"https://h/{i}", f'<a href="/{i + 1}">n</a><a href="/{i + 2}">m</a>') for i in range(7)]
    corpus = store_corpus(spark.createDataFrame([*pages, pages[3], ("https://k/", "<p>x</p>")], "url string, html string"), buckets=4)
    seeds = spark.createDataFrame([("h", "https://h/0"), ("k", "https://k/"), ("z", "https://z/")], "site string, url string")
    out = crawl_until_done(spark, corpus, seeds, 2, stored=True)
    tried = {(r.site, r.url): r.fetched for r in out["tried"].collect()}
    assert tried == {**{("h", f"https://h/{i}"): i < 7 for i in range(9)}, ("k", "https://k/"): True, ("z", "https://z/"): False}
    assert out["frontier"].count() == 0 and out["rounds"] == 5
    got = {(r.site, r["round"]): (r.fetched, r.total) for r in out["status"].collect()}
    assert got["h", 1] == (1, 1) and got["h", 2] == (2, 2) and got["z", 1] == (0, 1) and got["k", 2] == (0, 0)
    again = crawl_until_done(spark, corpus, seeds, 2, frontier=out["frontier"], crawled=out["crawled"], stored=True)
    assert again["rounds"] == 0 and again["fetched"].count() == 0 and again["crawled"].count() == 11


def test_fetch_from_a_stored_corpus_moves_no_html(spark):
    from skein.sources.corpus import open_corpus, store_corpus
    from test_plans import plan_of
    path = scratch_path(spark, "test-corpus")
    rows = [(f"https://h/{i}", "x" * 50 + str(i)) for i in range(200)] + [("https://h/7", "a"), (None, "z")]
    corpus = store_corpus(spark.createDataFrame(rows, "url string, html string"), path=path, buckets=4)
    batch = spark.createDataFrame([("h", f"https://h/{i}", 0) for i in range(190, 210)] + [("h", "https://h/7", 0), ("h", "https://h/a.pdf", 0)],
                                  "site string, url string, round int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for c in (corpus, open_corpus(spark, path, 4)):
            df = fr.fetch(batch, c, stored=True)
            plan = plan_of(df)
            html = plan[plan.index("Scan parquet"):]
            assert "SelectedBucketsCount: 4 out of 4" in html
            exchanges = [x for x in plan.split("\n\n") if "Exchange" in x.split("\n")[0] and "Input" in x]
            assert exchanges and not any("html" in x for x in exchanges)
            got = {r.url: (r.fetched, r.html) for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert len(got) == 22 and got["https://h/7"] == (True, "a") and got["https://h/209"] == (False, None)
    assert sum(f for f, _ in got.values()) == 11


def test_state_of_all_sites_round_trip(spark, tmp_path):
    rows = [("s1", "https://h/a b", 0), ("s2", "https://h/c", 3), ("s1", "https://h/c", 1)]
    fr.save_sites(spark.createDataFrame([*rows, ("s1", "https://h/c", 2)], "site string, url string, round int"), str(tmp_path / "state"))
    assert sorted(tuple(r) for r in fr.load_sites(spark, str(tmp_path / "state")).collect()) == sorted(rows)
    assert fr.load_sites(spark, str(tmp_path / "none")).count() == 0
