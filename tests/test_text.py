from html import unescape

from pyspark.sql import functions as F

from skein.functions.text import collapse_ws, decode_entities, fold_case, html_text, is_alpha, page_text


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("o")).first().o


def test_x1_visible_text(spark):
    html = '<title>T&amp;U</title><script>var t="</p>";</script><!-- c --><li>The</li><li>and</li>'
    assert one(spark, html_text, html) == "T&UTheand"


def test_doctype_style_template_entities(spark):
    html = ('<!DOCTYPE html><html><style>p{x:1}</style><template><b>hid</b></template>'
            '<p>a&lt;b &copy; &#233;&#x41;&amp;lt;</p></html>')
    assert one(spark, html_text, html) == "a<b © éA&lt;"


def test_collapse_python_whitespace(spark):
    s = " a  b\x1cc\t\n d  "
    assert one(spark, collapse_ws, s) == " ".join(s.split())


def test_isalpha_matches_python(spark):
    toks = ["cat", "cats,", "don't", "2024", "été", "straße", "a-b", "日本", "x1", ""]
    df = spark.createDataFrame([(t,) for t in toks], "t string")
    got = {r.t: r.a for r in df.select("t", is_alpha(F.col("t")).alias("a")).collect()}
    assert got == {t: t.isalpha() for t in toks}


def test_fold_case_is_upper_then_lower(spark):
    for w in ["Straße", "ﬁne", "ÉTÉ"]:
        assert one(spark, fold_case, w) == w.upper().lower()


def test_page_text_collapses(spark):
    assert one(spark, page_text, "<p>a\n\n b</p>  <p>c</p>") == "a b c"


def test_references_match_the_standard_library(spark):
    vals = ["&#38;lt;b", "caf&eacute;", "&#146;", "&#233 x", "&lt b", "&#0000000233;", "&amp;lt;", "a&b&&c;", "&notin;",
            "&notit;", "&#x1F600;z", "&#xD800;", "&#99999999999;", "&#0;", "&#x;", "&#;", "&", "x&amp", "&#1;q",
            "&#xFFFE;", "&#xFDD0;", "&NotEqualTilde;", "&copy2", "&#13;", "&#x00000000000041", "&AMP", "&bogus;",
            "&nbsp;x", "&#xfffffff;", "", "plain"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = {r.v: r.o for r in df.select("v", decode_entities(F.col("v")).alias("o")).collect()}
    assert got == {v: unescape(v) for v in vals}


def test_first_opener_of_comment_or_raw_block_wins(spark):
    html = "<p>x<script>if(a<!--b)c</script>KEEP<!-- z -->T"
    assert one(spark, html_text, html) == "xKEEPT"
    assert one(spark, html_text, "<!-- <script> -->A<script>b</script>") == "A"
