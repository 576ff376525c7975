"""URL filters by Bloom filter cascades.

A cascade answers membership of a listed set exactly for every key of a
universe.  Level 1 is a Bloom filter of the listed keys; level 2 one of the
universe's other keys that level 1 passes; level 3 one of the listed keys that
level 2 passes; and so on until nothing passes wrongly.  A key is listed when
the first level that rejects it is an even one, or when none of an odd number
of levels rejects it.  The universe is every candidate key of the whole
corpus, so no key that is looked up can be answered wrongly, and the lookup
itself needs no join: each level is an array of 64-bit words, sent to the
tasks as a scalar subquery.

Everything is built-in expressions: bits are set by a grouped ``bit_or``
(combined in each task) and tested with ``getbit``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm import common

FIRST_BITS = 12          # bits a key at level 1: few of the universe pass
LATER_BITS = 3           # bits a key at the later, small levels
MAX_BITS = 1 << 28       # 32 MB a level: the proven bound of what is sent
LEAST_WORDS = 100        # of a page that is not thin
RULES = (("net/", "block"), ("example.net/en/", "allow"),
         ("example.com/de/", "block"), ("org/fr/", "allow"))


class Level:
    """One Bloom filter: ``words`` is a one-row table (words array<bigint>)."""

    def __init__(self, words: DataFrame, bits: int, hashes: int, seed: int):
        self.words, self.bits, self.hashes, self.seed = words, bits, hashes, seed

    def positions(self, key: Column) -> list[Column]:
        a, b = F.xxhash64(key, F.lit(self.seed)), F.xxhash64(key, F.lit(-1 - self.seed))
        # a + i * b without overflow errors: both below 2^31
        a, b = F.pmod(a, F.lit(1 << 31)), F.pmod(b, F.lit(1 << 31))
        return [F.pmod(a + b * F.lit(i) + F.lit(i * i), F.lit(self.bits)) for i in range(self.hashes)]

    def passes(self, key: Column) -> Column:
        words, out = self.words.scalar(), None
        for p in self.positions(key):
            bit = F.call_function("getbit", F.get(words, F.call_function("shiftright", p, F.lit(6)).cast("int")),
                                  p.bitwiseAND(F.lit(63)).cast("int")) == 1
            out = bit if out is None else out & bit
        return F.coalesce(out, F.lit(False))


def build_level(keys: DataFrame, n: int, bits_per_key: int, seed: int) -> Level:
    """A filter of the ``n`` distinct ``keys`` (key)."""
    spark = keys.sparkSession
    bits = max(64, math.ceil(n * bits_per_key / 64) * 64)
    level = Level(None, bits, max(1, round(bits_per_key * math.log(2))), seed)
    pos = keys.select(F.explode(F.array(*level.positions(F.col("key")))).alias("p"))
    set_words = pos.groupBy(F.call_function("shiftright", "p", F.lit(6)).alias("i")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"),
                                 F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("w"))
    every = spark.range(bits // 64).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("w"))
    words = every.union(set_words).groupBy("i").agg(F.bit_or("w").alias("w"))
    one = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))),
                                lambda x: x["w"]).alias("words"))
    level.words = common.store(one, "cascade-level")
    return level


class Cascade:
    """Exact membership in ``listed`` (key) for every key of ``universe``
    (key): null keys belong to neither, repeated keys count once, listed keys
    outside the universe cost space only.  A list of which some level would
    pass MAX_BITS is kept as a table instead, and ``annotate`` then joins it."""

    def __init__(self, listed: DataFrame, universe: DataFrame, name: str = "cascade"):
        self.levels: list[Level] = []
        self.listed = common.store(listed.select(F.col("key").cast("string").alias("key"))
                                   .where("key is not null").distinct(), name)
        n = self.listed.count()
        self.as_table = n * FIRST_BITS > MAX_BITS
        if not n or self.as_table:
            return
        self.levels.append(build_level(self.listed, n, FIRST_BITS, 0))
        # those that pass level 1 are few: listed keys and its false positives
        passed = universe.select(F.col("key").cast("string").alias("key")).where(
            self.levels[0].passes(F.col("key"))).distinct()
        inside, outside = self.listed, common.store(passed.join(self.listed, "key", "left_anti"), name)
        while n := outside.count():
            if n * LATER_BITS > MAX_BITS:
                self.as_table, self.levels = True, []
                return
            self.levels.append(build_level(outside, n, LATER_BITS, len(self.levels)))
            inside, outside = outside, common.store(
                inside.where(self.levels[-1].passes(F.col("key"))), name)

    def contains(self, key: Column) -> Column:
        """Whether ``key``, of the universe, is listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(~self.levels[i].passes(key), F.lit(i % 2 == 1)).otherwise(out)
        return F.coalesce(out & key.isNotNull(), F.lit(False))

    def annotate(self, df: DataFrame, key: Column, name: str) -> DataFrame:
        """``df`` with boolean ``name``."""
        if not self.as_table:
            return df.withColumn(name, self.contains(key))
        side = self.listed.select(F.col("key").alias("__k"), F.lit(True).alias("__in"))
        return (df.withColumn("__key", key).join(side, F.col("__key") == F.col("__k"), "left")
                .withColumn(name, F.col("__in").isNotNull()).drop("__k", "__in", "__key"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(common.ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def split_rule(rule: str) -> tuple[str, str]:
    cut = rule.index("/")
    return rule[:cut], rule[cut:]


def candidates(host: Column, path: Column, rules) -> list[Column]:
    """Every key that a rule of the list could have and that fits the url: the
    host's suffixes of as many labels, and the path's prefixes of as many
    characters, as some rule has; longest first (null where the url is too
    short for one)."""
    parts = [split_rule(r) for r, _ in rules]
    shapes = sorted({(h.count(".") + 1, len(p)) for h, p in parts}, reverse=True)
    out = []
    for labels, chars in shapes:
        fits = (F.length(path) >= chars) & (F.size(F.split(host, r"\.")) >= labels)
        out.append(F.when(fits, F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, chars))))
    return out


def filter_urls(pages: DataFrame, rules=RULES, blocked_hosts: DataFrame | None = None,
                blocked_pages: DataFrame | None = None) -> DataFrame:
    """(__row, host, path, rule, verdict) for every row of ``pages`` (url and
    any other columns).

    ``rules`` are (host and path prefix, allow or block); the longest that fits
    the host or a parent of it decides.  Without a rule, a url whose host is in
    ``blocked_hosts`` (host), or whose host and path are in ``blocked_pages``
    (host, path), is blocked, any other allowed.  Null urls and urls without
    ``://`` have an empty host and path and are allowed, whatever is listed;
    very long urls are keys like others; repeated rows are judged alike; an
    empty table gives an empty result.  The rule list is a short parameter;
    listed hosts and pages may be many.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    one = pages.select(common.pack(pages), host.alias("host"), path.alias("path"))
    cand = candidates(F.col("host"), F.col("path"), rules)
    host_key = F.concat(F.lit("host "), F.col("host"))      # rule keys hold a slash, and no space at 5
    page_key = F.when(F.col("host") != "", F.concat(F.lit("page "), F.col("host"), F.lit(" "), F.col("path")))
    # the complete universe: all keys that any url of the corpus will look up
    keys = one.select("host", "path").distinct().select(F.explode(F.array(*cand, host_key, page_key)).alias("key"))
    universe = common.store(keys.where("key is not null").distinct(), "url-universe")
    lists = {v: spark.range(1).select(F.explode(F.lit([r for r, x in rules if x == v]).cast("array<string>")).alias("key"))
             for v in ("block", "allow")}
    if blocked_hosts is not None:
        lists["block"] = lists["block"].union(blocked_hosts.select(F.concat(F.lit("host "), F.col("host"))))
    if blocked_pages is not None:
        lists["block"] = lists["block"].union(blocked_pages.select(page_key))
    block, allow = (Cascade(lists[v], universe, f"url-{v}") for v in ("block", "allow"))
    out = one
    for i, c in enumerate(cand):
        out = out.withColumn(f"__c{i}", c)
        out = block.annotate(out, F.col(f"__c{i}"), f"__b{i}")
        out = allow.annotate(out, F.col(f"__c{i}"), f"__a{i}")
    out = block.annotate(block.annotate(out, host_key, "__host"), page_key, "__page")
    listed = F.col("__host") | F.col("__page")
    rule, verdict = F.lit(None).cast("string"), F.when(listed, "block").otherwise("allow")
    for i in reversed(range(len(cand))):
        rule = F.when(F.col(f"__b{i}") | F.col(f"__a{i}"), F.col(f"__c{i}")).otherwise(rule)
        verdict = F.when(F.col(f"__b{i}"), "block").when(F.col(f"__a{i}"), "allow").otherwise(verdict)
    return out.select(common.ROW, "host", "path", rule.alias("rule"), verdict.alias("verdict"))


SPAM_HOST = r"(^|[.-])spam([.-]|$)"


def spam_hosts(pages: DataFrame) -> DataFrame:
    """The hosts of the corpus with a label ``spam``: the list that the query
    blocks.  Any other list of hosts can take its place."""
    host, _ = url_parts(F.col("url"))
    return pages.select(host.alias("host")).where(F.col("host").rlike(SPAM_HOST)).distinct()


def thin_pages(pages: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(host, path) of pages whose html holds fewer than ``least`` words
    outside its tags: a list that grows with the corpus.  A null html says
    nothing about its page."""
    host, path = url_parts(F.col("url"))
    text = F.regexp_replace("html", r"<[^>]*>", " ")
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    return pages.where("html is not null").where(words < least).select(host.alias("host"), path.alias("path")).distinct()
