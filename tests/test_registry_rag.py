from pyspark.sql import functions as F

from skein.operators import rag, registry as rg

STATUS = "5 crawled, 2 remaining, Stopped."


def sites(spark):
    return spark.createDataFrame([("p", "u1", "https://h/", STATUS), ("p", "u2", "https://h/", STATUS),
                                  ("q", "u1", "https://k/", "Pending")],
                                 "pageid string, owner string, url string, status string")


def test_f6_set_crawling(spark):
    out = rg.set_crawling(sites(spark), spark.createDataFrame([("p",), ("q",)], "pageid string"))
    got = {(r.pageid, r.owner): r.status for r in out.collect()}
    # the first two comma parts are kept as split, so the second keeps its space
    crawling = "5 crawled,  2 remaining, Crawling..."
    assert crawling == "{}, {}, Crawling...".format(*STATUS.split(",")[:2])
    assert got == {("p", "u1"): crawling, ("p", "u2"): crawling, ("q", "u1"): "Pending"}


def test_f6_delete_and_register(spark):
    s = sites(spark)
    left = rg.delete_sites(s, spark.createDataFrame([("p", "u1")], "pageid string, owner string"))
    assert sorted((r.pageid, r.owner) for r in left.collect()) == [("p", "u2"), ("q", "u1")]
    ev = spark.createDataFrame([("p", "u1", "https://h/x", "Pending", 1), ("r", "u3", "https://r/", "Pending", 2),
                                ("r", "u3", "https://r/2", "Pending", 3)],
                               "pageid string, owner string, url string, status string, seq bigint")
    reg = {(r.pageid, r.owner): r.url for r in rg.register(s, ev).collect()}
    assert reg[("p", "u1")] == "https://h/" and reg[("r", "u3")] == "https://r/" and len(reg) == 4


def test_update_status_and_owner_view(spark):
    upd = spark.createDataFrame([("q", "1 crawled, 0 remaining, Stopped.")], "pageid string, status string")
    out = rg.update_status(sites(spark), upd)
    mine = {r.id: r.status for r in rg.sites_of_owner(out, "u1").collect()}
    assert mine == {"p": STATUS, "q": "1 crawled, 0 remaining, Stopped."}


def test_f7_prompt(spark):
    df = spark.createDataFrame([("https://h/a", "T", "q"), ("https://h/a.pdf", "T", "q")],
                               "url string, text string, query string")
    out = df.select(rag.prompt(rag.PROMPT_WEB, rag.context_text(F.col("url"), F.col("text")),
                               F.col("query")).alias("p")).collect()
    assert out[0].p == "You are an assistant providing answers based solely on context. Context: T\n Query: q"
    assert out[1].p == "You are an assistant providing answers based solely on context. Context: \n Query: q"


def test_registry_snapshots(spark, tmp_path):
    from skein.sources import registry_store
    root = str(tmp_path / "reg")
    empty = registry_store.load(spark, root)
    assert empty["sites"].count() == 0 and empty["site_keys"].count() == 0
    keys = spark.createDataFrame([("p", "h")], "hash string, host string")
    registry_store.save(sites(spark), keys, root, 1)
    upd = rg.set_crawling(sites(spark), spark.createDataFrame([("p",)], "pageid string"))
    registry_store.save(upd, keys, root, 2)
    cur = registry_store.load(spark, root)
    assert {r.status for r in cur["sites"].where("pageid = 'p'").collect()} == {
        "5 crawled,  2 remaining, Crawling..."}
    assert cur["site_keys"].count() == 1
    n = cur["sites"].count()
    registry_store.save(upd, keys, root, 2)                  # a retry replaces its version
    assert registry_store.load(spark, root)["sites"].count() == n
    sites(spark).limit(0).write.parquet(f"{root}/sites/version=3")       # a save that failed half-way
    assert registry_store.load(spark, root)["sites"].count() == n
