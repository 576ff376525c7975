"""Site registry maintenance as DataFrame jobs.

Tables: ``sites`` (pageid, owner, url, status), unique per (pageid, owner);
``site_keys`` (hash, host), unique per hash.  Every change is a DataFrame in
(a batch of events) and a new table out; storage keeps the history as a
change log of such batches (``skein.sources.registry_store``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.urls import host, site_hash

# Fixed value: what a status ends in while its site is crawled.
CRAWLING_SUFFIX = ", Crawling..."


def registration_events(pages: DataFrame, owner: F.Column, status: str = "Pending",
                        order_col: str = "page_id") -> DataFrame:
    """Registration requests (pageid, owner, url, status, seq) for crawl
    requests of ``pages`` (url), pageid = sha256(host)."""
    return pages.select(site_hash(host(F.col("url"))).alias("pageid"), owner.alias("owner"),
                        F.col("url"), F.lit(status).alias("status"),
                        F.col(order_col).alias("seq"))


def register(sites: DataFrame, events: DataFrame) -> DataFrame:
    """R2: add (pageid, owner) rows not registered yet; among requests for the
    same pair the earliest (``seq``) wins."""
    first = (events.groupBy("pageid", "owner")
                   .agg(F.min_by(F.struct("url", "status"), F.col("seq")).alias("_e"))
                   .select("pageid", "owner", "_e.url", "_e.status"))
    new = first.join(sites.select("pageid", "owner"), ["pageid", "owner"], "left_anti")
    return sites.select("pageid", "owner", "url", "status").unionByName(new)


def upsert_site_keys(site_keys: DataFrame, events: DataFrame) -> DataFrame:
    """Merge (hash, host, seq) events into site_keys; the latest wins."""
    old = site_keys.select("hash", "host", F.lit(0).alias("_src"),
                           F.lit(None).cast("long").alias("seq"))
    new = events.select("hash", "host", F.lit(1).alias("_src"), F.col("seq").cast("long"))
    # newest = events over stored rows, then the highest seq; an aggregation,
    # so a host with very many events combines map-side
    order = F.struct("_src", F.coalesce(F.col("seq"), F.lit(-(1 << 62))))
    return (old.unionByName(new).groupBy("hash")
               .agg(F.max_by(F.col("host"), order).alias("host")))


def update_status(sites: DataFrame, updates: DataFrame) -> DataFrame:
    """Set ``status`` on every owner's row of each updated pageid
    (updates: pageid, status; one row per pageid)."""
    u = updates.select("pageid", F.col("status").alias("_new"))
    return (sites.join(u, "pageid", "left")
                 .select("pageid", "owner", "url",
                         F.coalesce(F.col("_new"), F.col("status")).alias("status")))


def set_crawling(sites: DataFrame, pageids: DataFrame) -> DataFrame:
    """Mark sites as crawling: the first two comma-separated parts of the
    status are kept as they are (leading spaces included) and ', Crawling...'
    appended.  A status with no comma (e.g. 'Pending') is left unchanged
    instead of failing."""
    hit = sites.join(pageids.select("pageid").distinct().withColumn("_hit", F.lit(True)),
                     "pageid", "left")
    new_status = F.when(F.col("_hit"), crawling_status(F.col("status"))).otherwise(F.col("status"))
    return hit.select("pageid", "owner", "url", new_status.alias("status"))


def crawling_status(status: F.Column) -> F.Column:
    """The status of a site whose crawl goes on; one without a comma stays."""
    parts = F.split(status, ",")
    marked = F.concat(F.get(parts, F.lit(0)), F.lit(", "), F.get(parts, F.lit(1)), F.lit(CRAWLING_SUFFIX))
    return F.when(F.size(parts) >= 2, marked).otherwise(status)


def sites_of_owner(sites: DataFrame, owner: str) -> DataFrame:
    """(id, status, url) of an owner's sites."""
    return sites.where(F.col("owner") == owner).select(
        F.col("pageid").alias("id"), "status", "url")


def delete_sites(sites: DataFrame, requests: DataFrame) -> DataFrame:
    """Drop the (pageid, owner) rows named in ``requests``."""
    return sites.join(requests.select("pageid", "owner"), ["pageid", "owner"], "left_anti")


def is_indexed(requests: DataFrame, sites: DataFrame, host_col: str = "host") -> DataFrame:
    """(host, indexed) - whether any registered site has that host."""
    known = sites.select(host(F.col("url")).alias("_h")).distinct()
    flagged = requests.join(known.withColumn("indexed", F.lit(True)),
                            requests[host_col] == known["_h"], "left")
    return flagged.select(F.col(host_col).alias("host"),
                          F.coalesce(F.col("indexed"), F.lit(False)).alias("indexed"))


def host_of(hashes: DataFrame, site_keys: DataFrame) -> DataFrame:
    """(hash, host) for each requested site key; host null when unknown."""
    return hashes.select("hash").join(site_keys, "hash", "left")
