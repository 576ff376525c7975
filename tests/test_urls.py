from urllib.parse import quote, unquote, urljoin

from pyspark.sql import functions as F

from skein.functions import urls

HREFS = ["/a", "b", "?q", "#f", "../a", "/a/../b", "", None, "//o/x", "mailto:a@b",
         "https://other/?u=https://h", "c.PDF", "a/./b/../c", "a//b", "/a//b", "/a/..",
         "x?y/../z", "#", "?", "https:rel", "http://h/x", "HTTPS://H/X", " /sp", "./", "../../x",
         "a/b/..", "/é/ü?x=1#y"]
BASES = ["https://h", "http://h.com:80", "https://h?q"]


def test_resolve_matches_urljoin(spark):
    data = [(b, h) for b in BASES for h in HREFS]
    df = spark.createDataFrame(data, "base string, href string")
    got = urls.with_resolved(df, "base", "href", "link").collect()
    bad = [(r.base, r.href, r.link, urljoin(r.base, r.href)) for r in got
           if r.link != urljoin(r.base, r.href)]
    assert bad == []


def test_f4_scalars(spark):
    df = spark.createDataFrame([("https://a/x",), ("ftp://q",), ("https://h?q",),
                                ("https://h.com:80/x",)], "u string")
    out = df.select("u", urls.base_url(F.col("u")).alias("b"), urls.host(F.col("u")).alias("h"))
    got = {r.u: (r.b, r.h) for r in out.collect()}
    assert got["https://a/x"][0] == "https://a"
    assert got["ftp://q"][0] == ""
    assert got["https://h?q"][0] == "https://h?q"
    assert got["https://h.com:80/x"][1] == "h.com:80"
    key = spark.createDataFrame([("h",)], "h string").select(urls.site_hash(F.col("h"))).first()[0]
    assert key == "aaa9402664f1a41f40ebbc52c9993eb66aeb366602958fdfaa283b71e64db123"


def test_quote_unquote_match_python(spark):
    vals = ["a b*~c/é%", "https://h/a?x=1&y=2#z", "a+b", "x" * 250 + "é" * 30, "~_.-", "日本語/パス"]
    df = spark.createDataFrame([(v,) for v in vals], "u string")
    out = df.select("u", urls.doc_key(F.col("u"), cut=True).alias("k"),
                    urls.doc_key(F.col("u")).alias("full"))
    out = out.select("u", "k", "full", urls.unquote(F.col("k")).alias("back"),
                     urls.unquote(F.col("full")).alias("back_full"))
    for r in out.collect():
        assert r.k == quote(r.u, safe="")[:201]
        assert r.back == unquote(r.k)
        assert r.back_full == r.u
    plus = spark.createDataFrame([("a+b",)], "k string").select(urls.unquote(F.col("k"))).first()[0]
    assert plus == "a+b"


def test_crawlable(spark):
    vals = ["https://h/a.pdf", "https://h/a.PDF", "https://h/xpdf", "https://h/a.html", "https://h/x.XLSX"]
    df = spark.createDataFrame([(v,) for v in vals], "u string")
    got = {r.u: r.c for r in df.select("u", urls.is_crawlable(F.col("u")).alias("c")).collect()}
    assert got == {v: not any(v.lower().endswith(e) for e in urls.SKIPPED_ENDINGS) for v in vals}
