"""URL scalars as Column -> Column functions.

All are built-in string expressions.  ``resolve`` reproduces Python's
``urljoin(base, href)`` for the bases this engine produces (``scheme://host``
with no path); the dot-segment walk only runs for hrefs that need it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# URL endings the crawler never fetches (compared on the
# lower-cased URL, without a dot, as the crawler does).
SKIPPED_ENDINGS = ["jpg", "jpeg", "pdf", "png", "webp", "xls", "xlsx", "PDF"]

# What counts as scheme and host of a URL, and as its host.
BASE_RE = r"(https?://[^/]+)/"
HOST_RE = r"https?://([^/]+)/"
SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def base_url(u: Column) -> Column:
    """U1: 'scheme://host[:port]' of a URL, '' when it has no http(s) scheme."""
    return F.regexp_extract(F.concat(u, F.lit("/")), BASE_RE, 1)


def host(u: Column) -> Column:
    """U2: 'host[:port]' of a URL (no scheme), '' when none."""
    return F.regexp_extract(F.concat(u, F.lit("/")), HOST_RE, 1)


def site_hash(h: Column) -> Column:
    """Site key = hex sha256 of the host string."""
    return F.sha2(h, 256)


def site_key(u: Column) -> Column:
    return site_hash(host(u))


def is_crawlable(u: Column) -> Column:
    """U4: False for URLs ending in a skipped extension."""
    low = F.lower(u)
    out = None
    for ext in SKIPPED_ENDINGS:
        c = low.endswith(ext)
        out = c if out is None else (out | c)
    return ~out


def quote_all(u: Column) -> Column:
    """Python ``quote(u, safe='')``: percent-encode all but ``A-Za-z0-9_.-~``."""
    enc = F.url_encode(u)                     # form encoding: ' '->'+', '*' kept, '~'->%7E
    enc = F.replace(enc, F.lit("+"), F.lit("%20"))
    enc = F.replace(enc, F.lit("*"), F.lit("%2A"))
    return F.replace(enc, F.lit("%7E"), F.lit("~"))


def doc_key(u: Column, cut: bool = False) -> Column:
    """Key of a page: its quoted URL, whole; ``cut`` at 201 characters
    gives the file name of the original bundle layout."""
    q = quote_all(u)
    return F.substring(q, 1, 201) if cut else q


def unquote(k: Column) -> Column:
    """Python ``unquote``: '+' stays, a trailing partial escape stays."""
    tail = F.regexp_extract(k, r"%[0-9A-Fa-f]?$", 0)
    head = k.substr(F.lit(1), F.length(k) - F.length(tail))
    dec = F.try_url_decode(F.replace(head, F.lit("+"), F.lit("%2B")))
    return F.coalesce(F.concat(dec, tail), k)


# ---- urljoin(base, href) ----------------------------------------------------
def _dot_walk(path: Column, absolute: Column) -> Column:
    """Resolve '.' and '..' segments the way urljoin does against an empty
    base path."""
    segs = F.when(absolute, F.split(path, "/")).otherwise(
        F.concat(F.array(F.lit("")), F.split(path, "/")))
    # a relative path loses empty segments between the first and the last
    segs = F.when(absolute, segs).otherwise(
        F.filter(segs, lambda x, i: (x != "") | (i == 0) | (i == F.size(segs) - 1)))
    empty = F.array().cast("array<string>")
    walked = F.aggregate(
        segs, empty,
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                        .when(s == ".", acc)
                        .otherwise(F.concat(acc, F.array(s))))
    last = F.element_at(segs, -1)
    walked = F.when(last.isin(".", ".."), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    joined = F.array_join(walked, "/")
    joined = F.when(joined == "", F.lit("/")).otherwise(joined)
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def resolve_stages(base: str, href: str):
    """U5 as stages of (column, expression); each stage reads only columns of
    earlier stages, so no sub-expression is repeated.  Result in ``__link``."""
    b, hr = F.col(base), F.col(href)
    h, sch, aft, rel = F.col("__h"), F.col("__sch"), F.col("__aft"), F.col("__rel")
    path, query, frag = F.col("__path"), F.col("__q"), F.col("__frag")
    return [
        [("__h", F.regexp_replace(F.regexp_replace(hr, r"[\t\r\n]", ""), r"^[\x{00}-\x{20}]+", "")),
         ("__bsch", F.regexp_extract(b, r"^([a-z]+):", 1)),
         ("__root", F.concat(F.regexp_extract(b, r"^([a-z]+):", 1), F.lit("://"),
                             F.regexp_extract(b, r"^[a-z]+://([^?#]*)", 1))),
         ("__bq", F.regexp_extract(b, r"^[^?#]*\?([^#]*)", 1))],
        [("__sch", F.lower(F.regexp_extract(h, SCHEME_RE, 1))),
         ("__aft", F.regexp_replace(h, SCHEME_RE, ""))],
        [("__rel", F.when(sch != "", aft).otherwise(h))],
        [("__path", F.regexp_extract(rel, r"^([^?#]*)", 1)),
         ("__q", F.regexp_extract(rel, r"^[^?#]*\?([^#]*)", 1)),
         ("__frag", F.when(rel.contains("#"), F.regexp_extract(rel, r"#(.*)$", 1)).otherwise(F.lit("")))],
        [("__q", F.when((path == "") & (query == ""), F.col("__bq")).otherwise(query)),
         ("__abs", path.startswith("/")),
         ("__walk", path.rlike(r"(^|/)\.\.?(/|$)") | (~path.startswith("/") & path.contains("//")))],
        [("__tail", F.concat(F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
                             F.when(frag != "", F.concat(F.lit("#"), frag)).otherwise(F.lit("")))),
         ("__rpath", F.when(F.col("__walk"), _dot_walk(path, F.col("__abs")))
                      .when(F.col("__abs"), path).otherwise(F.concat(F.lit("/"), path)))],
        [("__link",
          F.when(hr.isNull() | (hr == ""), b)
           .when(b == "", hr)
           .when((sch != "") & (sch != F.col("__bsch")), hr)
           .when((sch != "") & aft.startswith("//"), F.concat(sch, F.lit(":"), aft))
           .when((sch == "") & h.startswith("//"), F.concat(F.col("__bsch"), F.lit(":"), h))
           .when(path == "", F.concat(F.col("__root"), F.col("__tail")))
           .otherwise(F.concat(F.col("__root"), F.col("__rpath"), F.col("__tail"))))],
    ]


_RESOLVE_TMP = ["__h", "__bsch", "__root", "__bq", "__sch", "__aft", "__rel", "__path",
                "__q", "__frag", "__abs", "__walk", "__tail", "__rpath", "__link"]


def with_resolved(df, base: str, href: str, out: str = "link"):
    """U5 on a DataFrame: adds ``out`` = urljoin(base, href).

    Python's urljoin for the bases this engine produces (scheme://netloc
    with no path): empty or missing href -> base; another scheme -> href as
    is; '//x' and 'scheme://x' -> absolute; otherwise resolved against the
    host root, '.' and '..' segments walked only where present.  Ends with a
    one-row Generate so later filters on the link are not inlined back into
    the stages."""
    cur = df
    for stage in resolve_stages(base, href):
        cur = cur.withColumns(dict(stage))
    keep = [c for c in df.columns if c != out]
    return cur.select(*keep, F.explode(F.array(F.col("__link"))).alias(out))
