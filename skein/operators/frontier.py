"""Crawl rounds over a page corpus.

State per site: ``frontier`` (site, url, round) and ``crawled`` (site, url,
round).  One round:

1. batch    = the first ``n`` frontier URLs of every site by (round, url); a
              site with an empty frontier starts from its seed (O3, L8);
2. fetched  = batch joined to the page corpus; a URL with a skipped ending or
              no page in the corpus is a failed fetch (U4, J5);
3. links    = in-scope links of the fetched pages that are not yet crawled
              (strict: nor in this batch) (L1-L4, J4);
4. crawled' = crawled + batch, fetched or not (L7);
5. frontier'= (frontier - batch) + links, one row per URL, earliest round
              kept (L5, L6);
6. status   = '<crawled> crawled, <frontier> remaining, Stopped.', with the
              fetched and all pages of the batch (A7).

``strict=False`` reproduces the original rule instead: links are checked
against the crawled set of the previous rounds only, and a seed used by the
round stays in the frontier.

The batch is bounded (n per site) and is broadcast after a size check, so
the corpus streams through the fetch join without a shuffle; the state tables
are written to the shared checkpoint folder every round to cut lineage.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein import schemas
from skein.functions.text import WS_CLASS
from skein.functions.urls import is_crawlable
from skein.operators.broadcast import broadcast_if_small
from skein.operators.links import new_links
from skein.sources.corpus import one_per_url
from skein.sources.tables import is_missing

# Fixed value: the status line of a site after a round.
STATUS_FMT = "%d crawled, %d remaining, Stopped."


def empty(spark: SparkSession, schema=schemas.FRONTIER) -> DataFrame:
    return spark.createDataFrame([], schema)


def with_seeds(frontier: DataFrame, seeds: DataFrame | None) -> DataFrame:
    """Sites with no frontier rows take their seed URL (round 0)."""
    if seeds is None:
        return frontier
    idle = seeds.join(frontier.select("site").distinct(), "site", "left_anti")
    return frontier.unionByName(
        idle.select("site", "url", F.lit(0).cast("int").alias("round")))


def frontier_batch(frontier: DataFrame, n: int) -> DataFrame:
    """O3: the first n URLs of each site's frontier, by (round, url).  Planned
    as a window group limit: each task keeps n rows per site before the shuffle."""
    w = Window.partitionBy("site").orderBy("round", "url")
    return (frontier.withColumn("_rn", F.row_number().over(w))
                    .where(F.col("_rn") <= n).drop("_rn"))


def frontier_stretch(pool: DataFrame, pace: DataFrame, n: int, most: int) -> DataFrame:
    """O3 for several rounds of a site at once: ``pool`` rows with ``at``, the
    round that takes them.  ``pace`` (site, done) has the rounds done so far.

    URLs are taken by (round, url), and links found in a round carry its
    number.  So they come after all URLs of earlier rounds, and the full
    batches of those are known before anything is fetched; a batch that would
    be filled up with new links waits for them.  A site without a full batch
    takes what it has, as one round does.  At most ``most`` rounds a site,
    which bounds the rows of a site that are ranked together."""
    w = Window.partitionBy("site").orderBy("round", "url")
    head = pool.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n * most)
    head = head.join(pace, "site", "left").withColumn("_next", F.coalesce(F.col("done"), F.lit(0)) + 1)
    full = head.groupBy("site").agg((F.floor(F.count_if(F.col("round") < F.col("_next")) / n) * n).alias("_full"))
    taken = head.join(broadcast_if_small(full), "site").where(F.col("_rn") <= F.when(F.col("_full") > 0, F.col("_full")).otherwise(n))
    at = F.col("_next") + F.floor((F.col("_rn") - 1) / n)
    return taken.select(*pool.columns, at.cast("int").alias("at"))


def frontier_rest(frontier: DataFrame, batch: DataFrame) -> DataFrame:
    """What stays in the frontier after the batch is taken."""
    return frontier.join(batch.select("site", "url"), ["site", "url"], "left_anti")


def fetch(batch: DataFrame, corpus: DataFrame, stored: bool = False) -> DataFrame:
    """(site, url, round, html, fetched) for every batch URL; html is null
    for a skipped ending or a URL missing from the corpus.

    A ``stored`` corpus (``sources.corpus``: one row a URL, bucketed by it) is
    joined inside its buckets, so only the batch is moved.  Of any other the
    pages of the batch are picked first; with a batch small enough to be
    broadcast only those are moved."""
    if stored:
        pages = corpus.select("url", "html")
    else:
        want = broadcast_if_small(batch.select("url").distinct())
        pages = one_per_url(corpus.select("url", "html").join(want, "url", "left_semi"))
    out = batch.join(pages, "url", "left")
    html = F.when(is_crawlable(F.col("url")), F.col("html"))
    more = [c for c in batch.columns if c not in ("site", "url", "round")]
    return out.select("site", "url", "round", html.alias("html"),
                      html.isNotNull().alias("fetched"), *more)


def union_urls(*frames: DataFrame) -> DataFrame:
    """Union, one row per (site, url), the earliest round kept."""
    u = frames[0].select("site", "url", "round")
    for f in frames[1:]:
        u = u.unionByName(f.select("site", "url", "round"))
    return u.groupBy("site", "url").agg(F.min("round").alias("round"))


def status(crawled: DataFrame, frontier: DataFrame) -> DataFrame:
    """Per site, counts and the status line of the registry."""
    c = crawled.groupBy("site").agg(F.count(F.lit(1)).alias("crawled"))
    r = frontier.groupBy("site").agg(F.count(F.lit(1)).alias("remaining"))
    out = c.join(r, "site", "full_outer").na.fill(0, ["crawled", "remaining"])
    return out.select("site", "crawled", "remaining",
                      F.format_string(STATUS_FMT, "crawled", "remaining").alias("status"))


def round_summary(fetched: DataFrame, status: DataFrame) -> DataFrame:
    """A7 of a round: per site, fetched and total pages of the batch, crawled
    and remaining URLs, and the status line."""
    f = fetched.groupBy("site").agg(F.count_if(F.col("fetched")).alias("fetched"), F.count(F.lit(1)).alias("total"))
    out = status.join(f, "site", "left").na.fill(0, ["fetched", "total"])
    return out.select("site", "fetched", "total", "crawled", "remaining", "status")


def crawl_round(frontier: DataFrame, crawled: DataFrame, corpus: DataFrame,
                n: int, round_no: int, pattern: str = "", seeds: DataFrame | None = None,
                strict: bool = True, same_host: bool = False,
                persist=None, stored: bool = False) -> dict[str, DataFrame]:
    """One crawl round; returns batch, fetched, links, crawled, frontier, status.

    ``persist(name, df) -> df`` materialises an intermediate table (the crawl
    job writes it to the shared folder and reads it back): the batch window
    and the corpus scan of the fetch then run once per round, not once per
    table that is written.  Without it the round is one lazy plan."""
    keep = persist or (lambda name, df: df)
    pool = with_seeds(frontier, seeds)
    batch = keep("batch", frontier_batch(pool, n))
    fetched = keep("fetched", fetch(batch, corpus, stored))
    pages = fetched.where("fetched").select("site", "url", "html")
    seen = crawled.select("site", "url")
    if strict:
        seen = seen.unionByName(batch.select("site", "url"))
    found = keep("links", new_links(pages, seen, pattern, same_host, keys=("site",))
                 .select("site", F.col("link").alias("url"), F.lit(round_no).alias("round")))
    crawled_next = keep("crawled", union_urls(
        crawled, batch.select("site", "url", F.lit(round_no).alias("round"))))
    rest = frontier_rest(pool, batch)
    if not strict and seeds is not None:
        # the original rule leaves a used seed in the frontier
        used = batch.join(seeds.select("site", "url"), ["site", "url"], "left_semi")
        rest = rest.unionByName(used)
    frontier_next = keep("frontier", union_urls(rest, found))
    return {"batch": batch, "fetched": fetched, "links": found,
            "crawled": crawled_next, "frontier": frontier_next,
            "status": round_summary(fetched, status(crawled_next, frontier_next))}


def save_state(df: DataFrame, path: str) -> DataFrame:
    """Write a state table into a new directory and read it back, which
    also cuts the lineage of the next round."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load_urls(spark: SparkSession, path: str, site: str) -> DataFrame:
    """One URL per line (crawled.txt / uncrawled.txt), trimmed and
    de-duplicated; a missing file is an empty set."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if not is_missing(e):
            raise
        return empty(spark)
    urls = lines.select(F.regexp_replace("value", f"^{WS_CLASS}+|{WS_CLASS}+$", "").alias("url")).where("url != ''").distinct()
    return urls.select(F.lit(site).alias("site"), "url", F.lit(0).cast("int").alias("round"))


def save_urls(df: DataFrame, path: str) -> None:
    """The URL column as text lines (the crawl-state file format)."""
    df.select("url").write.mode("overwrite").text(path)


def save_sites(df: DataFrame, path: str) -> None:
    """S6 for all sites and rounds at once: ``path``/round=<n>/ holds lines of
    a site key, a space and a URL, which ``load_sites`` reads back."""
    line = F.concat_ws(" ", "site", "url").alias("value")
    df.select(line, "round").write.mode("overwrite").partitionBy("round").text(path)


def load_sites(spark: SparkSession, path: str) -> DataFrame:
    """(site, url, round) of what ``save_sites`` wrote, each URL once with
    its earliest round; a missing folder is an empty set."""
    try:
        lines = spark.read.schema("value string, round int").text(path)
    except AnalysisException as e:
        if not is_missing(e):
            raise
        return empty(spark)
    cut = F.instr("value", " ")
    rows = lines.where(cut > 1).select(F.expr("substring(value, 1, instr(value, ' ') - 1)").alias("site"),
                                       F.expr("substring(value, instr(value, ' ') + 1)").alias("url"), "round")
    return union_urls(rows)
