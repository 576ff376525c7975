"""Text extraction and analysis as Column -> Column functions.

All of it is built-in Spark string expressions (regexp_replace / rlike /
split), so it runs inside whole-stage codegen with no Python per row.
"""

from __future__ import annotations

from html import unescape
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Python's str.split()/re \s see it: ASCII space and controls
# 0x09-0x0D, the separators 0x1C-0x1F, NEL, and every Unicode space separator.
# Written with \x{..} so the same class works in Java regex and RE2.
WS_CLASS = r"[\t\n\x{0b}\x{0c}\r\x{1c}-\x{1f}\x{85}\p{Z}]"
ALPHA_WORD = r"^\p{L}+$"           # str.isalpha(): one or more Unicode letters
PUNCT_CHARS = r"[^\p{L}\p{N}_\s]"  # what re.sub(r'[^\w\s]', '') removes

# Python's string.punctuation, the tokens dropped beside stopwords.
PUNCTUATION = list("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")

# The named HTML character references that the DuckDB checks of
# page text decode (name, character); the extractor knows all of them.  "amp"
# is applied last so "&amp;lt;" stays "&lt;".
HTML_ENTITIES = [
    ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "),
    ("copy", "©"), ("reg", "®"), ("trade", "™"), ("middot", "·"),
    ("hellip", "…"), ("mdash", "—"), ("ndash", "–"),
    ("laquo", "«"), ("raquo", "»"), ("lsquo", "‘"), ("rsquo", "’"),
    ("ldquo", "“"), ("rdquo", "”"), ("bull", "•"), ("deg", "°"),
    ("euro", "€"), ("pound", "£"), ("yen", "¥"), ("cent", "¢"),
    ("sect", "§"), ("para", "¶"), ("times", "×"), ("divide", "÷"),
    ("amp", "&"),
]

# Markup the text extractor drops entirely (comments, declarations, processing
# instructions, and the bodies of script / style / template elements).
COMMENT_RE = r"(?s)<!--.*?-->"
DECL_RE = r"<![^>]*>|<\?[^>]*>"
RAW_BLOCK_RE = r"(?is)<{0}(?:[\s/][^>]*)?>.*?</{0}\s*>"
TAG_RE = r"</?[A-Za-z][^>]*>"


def collapse_ws(c: Column) -> Column:
    """Runs of whitespace -> one space, then strip."""
    return F.trim(F.regexp_replace(c, WS_CLASS + "+", " "))


def is_alpha(c: Column) -> Column:
    """Python str.isalpha() on a token."""
    return c.rlike(ALPHA_WORD)


def fold_case(c: Column) -> Column:
    """upper() then lower(), as the indexer does before stemming.

    upper() can change a word ('ß' -> 'SS'), so the pair is not lower().
    Catalyst rewrites lower(upper(x)) to lower(x); the single-argument
    concat between them keeps both conversions."""
    return F.lower(F.concat(F.upper(c)))


def strip_punct(c: Column) -> Column:
    """Drop every character that is neither a word character nor space."""
    return F.regexp_replace(c, PUNCT_CHARS, "")


def _utf8_hex(cp: Column) -> Column:
    """Hex of the UTF-8 encoding of code point ``cp`` (for url-free decoding)."""
    def byte(x):
        return F.lpad(F.hex(x), 2, "0")
    cont = lambda shift: byte(F.shiftright(cp, shift).bitwiseAND(0x3F).bitwiseOR(0x80))
    return (F.when(cp < 0x80, byte(cp))
            .when(cp < 0x800, F.concat(byte(F.shiftright(cp, 6).bitwiseOR(0xC0)), cont(0)))
            .when(cp < 0x10000, F.concat(byte(F.shiftright(cp, 12).bitwiseOR(0xE0)),
                                         cont(6), cont(0)))
            .otherwise(F.concat(byte(F.shiftright(cp, 18).bitwiseOR(0xF0)),
                                cont(12), cont(6), cont(0))))


def _reference_table() -> Column:
    """Map of names (with their ``;``) and of ``#n`` for the code points that
    stand for another character or none, read from the Python standard library
    when the plan is built; Catalyst folds it to one literal."""
    table = {k: v for k, v in html5.items() if k.endswith(";")}
    for cp in range(0xA0):
        if unescape(f"&#{cp};") != chr(cp):
            table[f"#{cp}"] = unescape(f"&#{cp};")
    pairs = "\x01".join(f"{k}\x02{v}" for k, v in table.items())
    return F.str_to_map(F.lit(pairs), F.lit("\x01"), F.lit("\x02"))


def _bare_names() -> str:
    """Pattern of the names that need no ``;``, the longest first."""
    names = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
    return "^(" + "|".join(names) + ")"


def decode_entities(c: Column) -> Column:
    """Character references decoded in one pass from the left, as HTML has it:
    named ones with or without ``;``, and numbers of any length."""
    table = _reference_table()

    def piece(p):                       # what follows an "&", up to the next
        number = F.regexp_extract(p, r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", 0)
        dec = F.regexp_extract(number, r"^#0*([0-9]*)", 1)
        hx = F.regexp_extract(number, r"^#[xX]0*([0-9a-fA-F]*)", 1)
        is_hex = number.rlike("^#[xX]")
        cp = F.when(F.length(F.when(is_hex, hx).otherwise(dec)) > 7, F.lit(0x110000)).otherwise(
            F.coalesce(F.when(is_hex, F.conv(F.concat(F.lit("0"), hx), 16, 10)).otherwise(
                F.concat(F.lit("0"), dec)).cast("int"), F.lit(0)))
        none = cp.between(0xFDD0, 0xFDEF) | (cp.bitwiseAND(0xFFFE) == 0xFFFE)
        char = (F.when((cp > 0x10FFFF) | cp.between(0xD800, 0xDFFF), "\ufffd").when(none, "")
                .otherwise(F.coalesce(F.try_element_at(table, F.concat(F.lit("#"), cp.cast("string"))),
                                      F.decode(F.unhex(_utf8_hex(cp)), "UTF-8"))))
        name = F.regexp_extract(p, r"^[^\t\n\f <&#;]{1,32};", 0)
        full = F.try_element_at(table, name)
        bare = F.regexp_extract(p, _bare_names(), 1)
        after = lambda x: p.substr(F.length(x) + 1, F.length(p))
        return (F.when(number != "", F.concat(char, after(number)))
                .when(full.isNotNull(), F.concat(full, after(name)))
                .when(bare != "", F.concat(F.try_element_at(table, F.concat(bare, F.lit(";"))), after(bare)))
                .otherwise(F.concat(F.lit("&"), p)))
    parts = F.split(c, "&")
    decoded = F.concat(F.element_at(parts, 1),
                       F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), piece), ""))
    return F.when(c.contains("&"), decoded).otherwise(c)


def strip_markup(c: Column, keep_template: bool = False) -> Column:
    """Drop comments, declarations and raw-text blocks (script, style and,
    unless ``keep_template``, template)."""
    blocks = ["script", "style"] + ([] if keep_template else ["template"])
    # one pass: whichever opens first swallows the other
    every = [COMMENT_RE, *(RAW_BLOCK_RE.format(tag) for tag in blocks), DECL_RE]
    return F.regexp_replace(c, "|".join(f"(?:{r})" for r in every), "")


def html_text(c: Column) -> Column:
    """Visible text of an HTML document, text nodes joined with ''."""
    return decode_entities(F.regexp_replace(strip_markup(c), TAG_RE, ""))


def page_text(c: Column) -> Column:
    """X1 + X2: the stored text of a page."""
    return collapse_ws(html_text(c))
