"""Link extraction and scoping.

Anchors are found with a regex over the page after comments, declarations,
script and style bodies are dropped (their contents are not markup); template
bodies stay, since their anchors are real elements.  Every href is resolved
against the page's ``scheme://host`` (not the page URL), as the crawler does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import decode_entities, strip_markup
from skein.functions.urls import base_url, host, with_resolved

ANCHOR_RE = r"(?i)<a(?:[\s/][^>]*)?>"
HREF_RE = r"""(?i)[\s/]href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def anchors(pages: DataFrame, url_col: str = "url", html_col: str = "html",
            keys=("page_id",)) -> DataFrame:
    """L1: one row per <a> element: (keys..., url, pos, href); href is '' when
    the element has none (it then resolves to the base)."""
    html = strip_markup(F.col(html_col), keep_template=True)
    tags = pages.select(*keys, F.col(url_col).alias("url"),
                        F.posexplode(F.regexp_extract_all(html, F.lit(ANCHOR_RE), 0))
                        .alias("pos", "tag"))
    href = F.concat(F.regexp_extract("tag", HREF_RE, 1), F.regexp_extract("tag", HREF_RE, 2),
                    F.regexp_extract("tag", HREF_RE, 3))
    return tags.select(*keys, "url", "pos", decode_entities(href).alias("href"))


def resolved_links(pages: DataFrame, keys=("page_id",), **kw) -> DataFrame:
    """U5 over L1: (keys..., url, pos, base, link)."""
    a = anchors(pages, keys=keys, **kw).withColumn("base", base_url(F.col("url")))
    return with_resolved(a, "base", "href", "link").select(*keys, "url", "pos", "base", "link")


def in_scope(links: DataFrame, pattern: str = "", same_host: bool = False) -> DataFrame:
    """L2 + L3: the base must occur in the link (substring, as the crawler
    tests it) and so must ``pattern``; ``same_host`` also requires equal hosts."""
    cond = F.col("link").contains(F.col("base")) & F.col("link").contains(F.lit(pattern))
    if same_host:
        cond = cond & (host(F.col("link")) == host(F.col("url")))
    return links.where(cond)


def new_links(pages: DataFrame, seen: DataFrame, pattern: str = "",
              same_host: bool = False, keys=("site",)) -> DataFrame:
    """L1-L4 + J4: distinct (keys..., link) found on ``pages`` that are in
    scope and not in ``seen`` (keys..., url)."""
    links = in_scope(resolved_links(pages, keys=keys), pattern, same_host)
    fresh = links.join(seen.select(*keys, F.col("url").alias("link")), [*keys, "link"], "left_anti")
    return fresh.select(*keys, "link").distinct()


def links_per_page(pages: DataFrame, seen: DataFrame, pattern: str = "",
                   keys=("site",)) -> DataFrame:
    """Number of distinct qualifying links found on each page (keys..., url, n)."""
    links = in_scope(resolved_links(pages, keys=keys), pattern)
    fresh = links.join(seen.select(*keys, F.col("url").alias("link")), [*keys, "link"], "left_anti")
    return (fresh.select(*keys, "url", "link").distinct()
                 .groupBy(*keys, "url").agg(F.count(F.lit(1)).alias("n")))
