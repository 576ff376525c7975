"""Crawl for several rounds over a page corpus and index what was fetched.

Every round's state (frontier, crawled) and fetched pages are written to a
new directory in the shared checkpoint folder and read back, which cuts the
lineage (round k's plan does not contain rounds 1..k-1) and lets a lost
executor cost at most the current round.  The driver only loops over round
numbers and reads the per-site status rows; no URL or page passes through it.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators import frontier as fr
from skein.operators import index as ix
from skein.operators import links as lk
from skein.session import scratch_path


class Crawl:
    """Rounds over stored state: frontier and crawled tables of the last round
    and the folders of every round."""

    def __init__(self, corpus: DataFrame, seeds: DataFrame, n: int, pattern: str = "", strict: bool = True,
                 same_host: bool = False, frontier: DataFrame | None = None, crawled: DataFrame | None = None,
                 root: str | None = None, stored: bool = False):
        self.spark = corpus.sparkSession
        self.corpus, self.seeds, self.n, self.stored = corpus, seeds, n, stored
        self.rules = {"pattern": pattern, "strict": strict, "same_host": same_host}
        self.frontier = frontier if frontier is not None else fr.empty(self.spark)
        self.crawled = crawled if crawled is not None else fr.empty(self.spark)
        self.root = root or scratch_path(self.spark, "crawl")
        self.rounds = 0

    def _dirs(self, name: str) -> list[str]:
        return [os.path.join(self.root, f"round={r}", name) for r in range(1, self.rounds + 1)]

    def round(self, seeds: DataFrame | None) -> DataFrame:
        """One more round; returns its batch."""
        r = self.rounds + 1
        base = os.path.join(self.root, f"round={r}")
        persist = lambda name, df: fr.save_state(df, os.path.join(base, name))
        out = fr.crawl_round(self.frontier, self.crawled, self.corpus, self.n, r, seeds=seeds, persist=persist,
                             stored=self.stored, **self.rules)
        self.frontier, self.crawled = out["frontier"], out["crawled"]
        persist("status", out["status"].withColumn("round", F.lit(r)))
        self.rounds = r
        return out["batch"]

    def result(self) -> dict:
        """frontier, crawled, fetched pages (site, url, round, html), every
        page tried (site, url, round, fetched) and the status of every round;
        fetched, tried and status are empty where no round was run."""
        if not self.rounds:
            none = lambda ddl: self.spark.createDataFrame([], ddl)
            return {"frontier": self.frontier, "crawled": self.crawled, "rounds": 0,
                    "fetched": none("site string, url string, round int, html string"),
                    "tried": none("site string, url string, round int, fetched boolean"),
                    "status": none("site string, fetched bigint, total bigint, crawled bigint, remaining bigint, "
                                   "status string, round int")}
        tried = self.spark.read.parquet(*self._dirs("fetched"))
        return {"frontier": self.frontier, "crawled": self.crawled,
                "fetched": tried.where("fetched").select("site", "url", "round", "html"),
                "tried": tried.select("site", "url", "round", "fetched"),
                "status": self.spark.read.parquet(*self._dirs("status")), "rounds": self.rounds}


def crawl(spark: SparkSession, corpus: DataFrame, seeds: DataFrame, rounds: int,
          n: int, pattern: str = "", **kw) -> dict:
    """Run ``rounds`` rounds.  ``seeds`` (site, url); returns the final
    frontier, crawled set, fetched pages (site, url, round, html) and the
    status of every round."""
    job = Crawl(corpus, seeds, n, pattern, **kw)
    for _ in range(rounds):
        job.round(seeds)
    return job.result()


def crawl_until_done(spark: SparkSession, corpus: DataFrame, seeds: DataFrame, n: int,
                     pattern: str = "", **kw) -> dict:
    """L8 + L9: rounds until no site has a frontier.  A site without one takes
    its seed while that is not crawled; every round crawls URLs that were not,
    so with finitely many in scope the rounds end.  Strict rule only: by the
    original one a used seed comes back for ever.

    The rounds of a site depend on that site alone, and all its full batches
    of known URLs are taken in one step (``frontier.frontier_stretch``), so
    the steps follow the depth of the links and not the number of pages; the
    rounds, and what each of them takes, are those of round after round."""
    if not kw.pop("strict", True):
        raise ValueError("the original rule does not settle")
    job = Stretches(corpus, seeds, n, pattern, **kw)
    while job.step():
        pass
    return job.result()


class Stretches:
    """A crawl to its end, several rounds of a site in a step.  The state and
    what a step found lie in a folder a step."""

    MOST = 1000        # rounds of a site in one step

    def __init__(self, corpus: DataFrame, seeds: DataFrame, n: int, pattern: str = "", same_host: bool = False,
                 frontier: DataFrame | None = None, crawled: DataFrame | None = None, root: str | None = None,
                 stored: bool = False):
        self.spark, self.corpus, self.n, self.stored = corpus.sparkSession, corpus, n, stored
        self.pattern, self.same_host = pattern, same_host
        self.root, self.steps = root or scratch_path(self.spark, "crawl"), 0
        known = lambda df: df.where("site is not null and url is not null")  # noqa: E731  others cannot be crawled
        self.seeds = self._keep("seeds", known(seeds.select("site", "url")))
        self.frontier = known(frontier) if frontier is not None else fr.empty(self.spark)
        self.crawled = crawled if crawled is not None else fr.empty(self.spark)
        self.first = {"frontier": self.frontier, "crawled": self.crawled}
        self.pace = self.spark.createDataFrame([], "site string, done int")

    def _keep(self, name: str, df: DataFrame) -> DataFrame:
        return fr.save_state(df, os.path.join(self.root, f"step={self.steps}", name))

    def _all(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*[os.path.join(self.root, f"step={i}", name) for i in range(1, self.steps + 1)])

    def step(self) -> bool:
        """Whether there was anything left to do."""
        left = self.seeds.join(self.crawled.select("site", "url"), ["site", "url"], "left_anti")
        idle = left.join(self.frontier.select("site").distinct(), "site", "left_anti")
        pool = self.frontier.select("site", "url", "round", F.lit(False).alias("seeded")).unionByName(
            idle.select("site", "url", F.lit(0).alias("round"), F.lit(True).alias("seeded")))
        if pool.isEmpty():
            return False
        self.steps += 1
        batch = self._keep("batch", fr.frontier_stretch(pool, self.pace, self.n, self.MOST))
        fetched = self._keep("fetched", fr.fetch(batch, self.corpus, self.stored))
        pages = fetched.where("fetched").select("site", "url", "html", "at")
        links = lk.in_scope(lk.resolved_links(pages, keys=("site", "at")), self.pattern, self.same_host)
        links = links.groupBy("site", "link").agg(F.min("at").alias("round"))
        seen = pool.select("site", "url").unionByName(self.crawled.select("site", "url"))
        found = self._keep("found", links.join(seen.withColumnRenamed("url", "link"), ["site", "link"], "left_anti")
                           .select("site", F.col("link").alias("url"), "round"))
        rest = fr.frontier_rest(pool.select("site", "url", "round"), batch)
        self.crawled = self._keep("crawled", fr.union_urls(
            self.crawled, batch.select("site", "url", F.col("at").alias("round"))))
        self.frontier = self._keep("frontier", fr.union_urls(rest, found))
        done = batch.select("site", F.col("at").alias("done")).unionByName(self.pace)
        self.pace = self._keep("pace", done.groupBy("site").agg(F.max("done").alias("done")))
        return True

    def status(self, rounds: int) -> DataFrame:
        """The row of every site and round, from what the steps wrote."""
        batch, found = self._all("fetched"), self._all("found")
        count = lambda df, *keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        change = batch.groupBy("site", F.col("at").alias("round")).agg(
            F.count_if("fetched").alias("fetched"), F.count(F.lit(1)).alias("total"),
            F.count_if(~F.col("seeded")).alias("_out"))
        again = count(batch.join(self.first["crawled"].select("site", "url"), ["site", "url"], "left_semi"),
                      "site", F.col("at").alias("round")).withColumnRenamed("_n", "_again")
        change = change.join(again, ["site", "round"], "left").join(
            count(found, "site", "round").withColumnRenamed("_n", "_in"), ["site", "round"], "left")
        start = None
        for name, c in (("crawled", "_c0"), ("frontier", "_f0")):
            n = count(self.first[name].select("site", "url").distinct(), "site").withColumnRenamed("_n", c)
            start = n if start is None else start.join(n, "site", "full_outer")
        start = start.join(batch.select("site").distinct(), "site", "full_outer")
        grid = start.crossJoin(self.spark.range(1, rounds + 1).select(F.col("id").cast("int").alias("round")))
        grid = grid.join(change, ["site", "round"], "left").na.fill(0)
        upto = Window.partitionBy("site").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
        grid = grid.select("site", "fetched", "total", "round",
                           (F.col("_c0") + F.sum(F.col("total") - F.col("_again")).over(upto)).alias("crawled"),
                           (F.col("_f0") + F.sum(F.col("_in") - F.col("_out")).over(upto)).alias("remaining"))
        told = F.format_string(fr.STATUS_FMT, "crawled", "remaining").alias("status")
        return grid.select("site", "fetched", "total", "crawled", "remaining", told, "round")

    def result(self) -> dict:
        """As ``Crawl.result``."""
        if not self.steps:
            return Crawl(self.corpus, self.seeds, self.n, frontier=self.frontier, crawled=self.crawled).result()
        rounds = self.pace.agg(F.max("done")).first()[0]
        tried = self._all("fetched")
        return {"frontier": self.frontier, "crawled": self.crawled,
                "fetched": tried.where("fetched").select("site", "url", "round", "html"),
                "tried": tried.select("site", "url", "round", "fetched"),
                "status": self.status(rounds), "rounds": rounds}


def index_fetched(fetched: DataFrame, stopwords="nltk") -> dict:
    """Index the fetched pages under their crawl's site; a page fetched in
    several rounds keeps its latest version (the overwrite rule, W2)."""
    latest = ix.latest_versions(fetched.withColumn("doc_key", F.col("url")), order_col="round")
    return ix.build_index(ix.docs_from_pages(latest, site_col="site"), stopwords)
