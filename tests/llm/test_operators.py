import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures_llm import (CLASH, DOC_DDL, components, contamination, dedup_lines, docs, measures, repeats, rows, texts)
from skein.llm import (bpe, bpe_codec, classifier, common, decontam, jaccard, line_dedup, quality, suffix, token_count,
                       url_filter, warc)

ROW = common.ROW


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# ---- 1 ------------------------------------------------------------------------
def test_quality_measures_and_clean_rows(spark):
    data = rows()
    j = quality.judge(docs(spark, clash=True))
    cols = [F.col(f"m.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")]
    out = got(j, f"{ROW}.doc_id", *cols)
    assert out == sorted([(d[0], *measures(d[1])) for d in data], key=repr)
    kept = quality.quality_filter(docs(spark, clash=True))
    assert kept.columns == DOC_DDL.replace(" bigint", "").replace(" string", "").split(", ") + CLASH
    assert {0, 4, 5} <= {r[0] for r in kept.select("doc_id").collect()}
    assert quality.quality_filter(docs(spark, data=[])).count() == 0


def test_quality_repeats_exact_beyond_64_bits():
    r = np.random.RandomState(1)
    words = [b"%d" % i for i in r.permutation(20000)]
    words += words[100:110]
    assert quality.measure(b" ".join(words))[4] == 20


def test_quality_adapts_to_the_group(spark):
    """Ten symbols a word pass where they are usual and fail elsewhere."""
    plain, table = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam{}", "al | be | ga | de | ep | ze | et | th | io | ka{} |"
    data = [(i, plain.format(i), "en", "prose", 1) for i in range(80)]
    data += [(100 + i, table.format(i), "en", "tables", 1) for i in range(80)]
    data += [(300, table.format("x"), "en", "prose", 1)]
    out = {r["doc_id"]: r["kept"] for r in quality.judge(docs(spark, data=data)).select(f"{ROW}.doc_id", "kept").collect()}
    assert all(out[i] for i in range(80)) and all(out[100 + i] for i in range(80)) and not out[300]


# ---- 2 ------------------------------------------------------------------------
URLS = [None, "", "no scheme", "http://", "http://Net/", "http://a.NET", "http://a.net?q", "https://x.example.net/en/1",
        "https://example.net/en", "ftp://m.Example.com/de/x?y#z", "http://example.org/fr/", "http://fr.org/fr/x",
        "http://spam-farm.example.org/en/1", "http://xnet/", "http://net.com/", "http://a.b.c.d.net/#/", "x://É.net/\n/a"]


def brute_url(u):
    host = path = ""
    if u and "://" in u:
        rest = u[u.index("://") + 3:]
        cut = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[:min([i for i, c in enumerate(tail) if c in "?#"], default=len(tail))]
    best = None
    for r, v in url_filter.RULES:
        h, p = url_filter.split_rule(r)
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(r) > len(best[0])):
            best = (r, v)
    spam = "block" if host.startswith("spam") else "allow"
    return host, path, best and best[0], best[1] if best else spam


def test_urls_brute(spark):
    html = [None, "<p>a few words</p>", "<p>" + "many words " * 60, "<a " + "x " * 200 + ">none</a>"]
    data = [(i, u, "x", "y", html[i % 4]) for i, u in enumerate(URLS + URLS[5:8] + ["http://q.org/" + "p" * 9000] * 2)]
    data += [(None, "http://n.org/", "x", "y", html[1]), data[5], (50, "http://z.org/x?y", "x", "y", html[1]), (51, "http://z.org/x#y", "x", "y", None)]
    p = spark.createDataFrame(data, "page_id bigint, url string, host string, verdict string, html string")
    out = url_filter.filter_urls(p, blocked_hosts=url_filter.spam_hosts(p), blocked_pages=url_filter.thin_pages(p))
    thin = {brute_url(d[1])[:2] for d in data if d[4] in (html[1], html[3])}
    want = []
    for i, u, *_ in data:
        host, path, rule, verdict = brute_url(u)
        want.append((i, host, path, rule, "block" if rule is None and host and (host, path) in thin else verdict))
    assert got(out, f"{ROW}.page_id", "host", "path", "rule", "verdict") == sorted(want, key=repr)
    assert sum(w[4] == "block" and w[3] is None for w in want) > 3
    assert url_filter.filter_urls(p.limit(0)).count() == 0 and url_filter.thin_pages(p.limit(0)).count() == 0


@pytest.mark.parametrize("listed,universe", [(300, 20000), (1, 50), (0, 10)])
def test_cascade_is_exact(spark, monkeypatch, listed, universe):
    monkeypatch.setattr(url_filter, "FIRST_BITS", 4)      # many false positives, several levels
    u = spark.range(universe).select(F.concat(F.lit("k"), "id").alias("key"))
    c = url_filter.Cascade(u.where(F.col("key").isin([f"k{i * 7}" for i in range(listed)]) if listed else F.lit(False)), u)
    assert len(c.levels) >= (3 if listed > 100 else 0)
    out = {r["key"] for r in u.where(c.contains(F.col("key"))).collect()}
    assert out == {f"k{i * 7}" for i in range(listed) if i * 7 < universe}


@pytest.mark.parametrize("most,first", [(64, 12), (400, 4)])       # the first level, a later one
def test_cascade_beyond_its_bound_joins(spark, monkeypatch, most, first):
    monkeypatch.setattr(url_filter, "MAX_BITS", most)
    monkeypatch.setattr(url_filter, "FIRST_BITS", first)
    monkeypatch.setattr(url_filter, "LATER_BITS", 12)
    u = spark.range(400).select(F.col("id").cast("string").alias("key"))
    c = url_filter.Cascade(u.where("key < '5'"), u)
    assert c.as_table
    assert c.annotate(u, F.col("key"), "in").where(F.col("in") != (F.col("key") < "5")).count() == 0


# ---- 3, 6 ---------------------------------------------------------------------
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(bpe.default_path())


def test_bpe_equals_the_library(spark):
    t, data = library(), rows()
    enc = t.encode_batch([d[1] or "" for d in data], add_special_tokens=False)
    want = []
    for d, e in zip(data, enc):
        text = t.decode(e.ids, skip_special_tokens=False)
        want.append((d[0], len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(text.encode()).hexdigest()))
    r = bpe_codec.round_trip(docs(spark, clash=True))
    assert got(r, f"{ROW}.doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    c = token_count.token_counts(docs(spark, clash=True))
    assert got(c, f"{ROW}.doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(
        [(d[0], len((d[1] or "").encode()), len(e.ids), len(e.ids) > 2048) for d, e in zip(data, enc)], key=repr)
    assert bpe_codec.round_trip(docs(spark, data=[])).count() == 0


def test_bpe_any_text():
    import random
    r, t = random.Random(3), library()
    some = ["".join(chr(r.choice([r.randrange(1, 128), r.randrange(128, 0x400), r.randrange(0x400, 0xD7FF),
                                  r.randrange(0x10000, 0x1FFFF)])) for _ in range(r.randrange(1, 50))) for _ in range(1500)]
    some += ["<|endoftext|>", "a<|startoftext|> b", "<|x", "ΑΣ.", "İ", "''s's", "aaaa" * 300, "\x1c\x1d=\x1e"]
    c, k = bpe_codec.Codec(bpe.default_path()), token_count.Counter(bpe.default_path())
    for x, ids, e in zip(some, bpe_codec.encode_many(c, some), t.encode_batch(some, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids
        assert k.count(x) == len(e.ids)
        assert c.decode(ids).decode() == t.decode(e.ids, skip_special_tokens=False)


def test_merge_rounds_when_pairs_are_out_of_order():
    """One merge a round gives the same ids as all at once."""
    c = bpe_codec.Codec(bpe.default_path())
    words = [w.encode() for w in ["banana", "ababababab", "aaaaa", "therethere", "x"]]
    fast = bpe_codec.merge_rounds(c.v, words)
    c.v.in_order = False
    try:
        assert bpe_codec.merge_rounds(c.v, words) == fast
    finally:
        c.v.in_order = True


# ---- 4 ------------------------------------------------------------------------
def bench(spark, data):
    t = texts()
    items = [(1, t[4]), (2, t[9]), (3, "alone here"), (4, None), (5, ""), (6, t[4]), (7, "É é")]
    return spark.createDataFrame(items, "item_id bigint, text string"), items


def test_decontamination_brute(spark):
    data = rows() + [(900, "We are ALONE, here; é é.", "en", "s1", 1)]
    b, items = bench(spark, data)
    c = decontam.contamination(docs(spark, clash=True, data=data), b)
    ids = F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",").cast("binary"), 256)
    out = got(c, f"{ROW}.doc_id", "n_words", "n_hit", F.size("items"), ids)
    assert out == sorted([(d[0], *contamination(d[1], items)) for d in data], key=repr)
    clean = decontam.decontaminate(docs(spark, clash=True, data=data), b)
    assert got(clean, "doc_id") == sorted([(d[0],) for d in data if not contamination(d[1], items)[1]], key=repr)
    assert decontam.decontaminate(docs(spark, data=[]), b).count() == 0
    assert decontam.decontaminate(docs(spark), b.limit(0)).count() == len(rows())


def test_decontamination_cuts_spans(spark):
    b = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    data = [(1, "Say: One, two; THREE! and more one two", "en", "s", 1), (2, "one two three", "en", "s", 1), (3, None, "en", "s", 1)]
    out = decontam.decontaminate(docs(spark, data=data), b, remove="spans")
    assert got(out, "doc_id", "text") == [(1, "Say: ! and more one two"), (2, ""), (3, None)]


def test_decontamination_of_a_long_text_with_many_runs(spark):
    import time
    b = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    data = [(1, "! ".join(["one two three", "other words here"] * 16000), "en", "s", 1)]
    start = time.monotonic()
    out = decontam.decontaminate(docs(spark, data=data), b, remove="spans").first()
    assert out["text"] == "! other words here! " * 15999 + "! other words here"
    assert time.monotonic() - start < 60
    c = decontam.contamination(docs(spark, data=data), b).select("n_words", "n_hit", F.size("spans")).first()
    assert tuple(c) == (96000, 48000, 16000)


# ---- 5 ------------------------------------------------------------------------
@pytest.mark.parametrize("sites", [2, 4])
def test_line_dedup_brute(spark, sites):
    data = rows()
    r = line_dedup.remove_lines(docs(spark, clash=True), min_sites=sites, min_words=3)
    want = dedup_lines([(d[0], d[1], d[3]) for d in data], sites, 3)
    assert got(r, f"{ROW}.doc_id", "text", "n_removed") == sorted([(d[0], *w) for d, w in zip(data, want)], key=repr)
    assert sum(w[1] for w in want) > 0
    kept = line_dedup.dedup(docs(spark, clash=True), sites, 3)
    assert kept.columns[5:] == CLASH
    assert line_dedup.dedup(docs(spark, data=[])).count() == 0


# ---- 7 ------------------------------------------------------------------------
def test_classifier_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality")
    held = F.pmod(F.xxhash64("doc_id", F.lit("test")), F.lit(4)) == 0
    odd = d.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"),
                            F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "n_chars")
    s = classifier.classify(d.union(odd), lab.where(~held), carry=["doc_id"]).select(f"{ROW}.doc_id", "score", "kept")
    s = common.store(s, "test-scores")
    assert s.count() == d.count() + 1 and s.where("score is null").count() == 0
    right = s.join(lab.where(held), "doc_id").groupBy("quality").agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int"))).collect()
    assert all(r[1] > 0.85 for r in right), right


def test_classifier_learns_from_the_whole_pool(spark):
    """Each of 40 rare words is in one unlabelled document of a large table."""
    n = 30_000
    rare = F.when(F.col("id") % 750 == 7, F.concat(F.lit("rare"), F.col("id"))).otherwise("plain")
    d = spark.range(n).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", F.when(F.col("id") % 2 == 1, "good fine").otherwise("bad poor"), rare).alias("text"),
        F.lit("en").alias("lang"), F.when(F.col("id") % 2 == 1, "a").otherwise("b").alias("source"))
    lab = spark.range(0, n, 10).select(F.col("id").alias("doc_id"), F.lit(0).alias("y")).union(
        spark.range(1, n, 10).select("id", F.lit(1)))
    some, share = classifier.labelled_sample(lab.where("doc_id % 750 <> 7"), classifier.MAX_LABELLED)
    m = classifier.co_train(classifier.feature_rows(d, some, []), share, rounds=1)
    tf = classifier.HashingTF(numFeatures=classifier.TEXT_FEATURES)
    usual = {tf.indexOf(w) for w in ("good", "fine", "bad", "poor", "plain")}
    at = {tf.indexOf(f"rare{i}") for i in range(7, n, 750)} - usual
    assert len(at) > 30 and all(m.text.coefficients[i] != 0 for i in at)


def newton(x, y, w, reg):
    """L2-penalised logistic regression with a free intercept, by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    r = np.diag([reg] * x.shape[1] + [0.0])
    b = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-a @ b))
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a / w.sum() + r, a.T @ (w * (p - y)) / w.sum() + r @ b)
        b -= step
        if np.abs(step).max() < 1e-10:
            break
    return b


def test_classifier_brute(spark, monkeypatch):
    """Co-training on a small table against the same rounds in numpy."""
    monkeypatch.setattr(classifier, "ITERATIONS", 500)         # fits that settle can be compared
    import random
    r = random.Random(12)
    good, bad, any_ = ["fine", "clear", "useful", "solid"], ["spam", "junk", "buy", "now"], [f"w{i}" for i in range(12)]
    data = []
    for i in range(240):
        kind = i % 2 if i % 9 else r.randrange(2)
        text = " ".join(r.choices(any_, k=r.randrange(3, 14)) + r.choices(good if kind else bad, k=r.randrange(0, 3)))
        data.append((i, text, ["en", "de"][r.randrange(2)], f"s{r.randrange(2) + 2 * kind}", len(text)))
    labels = [(i, int(data[i][3] > "s1")) for i in range(240) if i % 4 < 2] + [(2, 0), (2, 1), (None, 1), (3, None)]
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int")
    some, share = classifier.labelled_sample(lab.withColumnRenamed("quality", "y"), 1000)
    assert share == 1.0 and some.count() == 120
    d = docs(spark, clash=True, data=data + [data[0], (None, data[5][1], "en", "s0", 1)])
    rows_ = sorted(classifier.feature_rows(d, some, []).where("doc_id is not null").withColumn(
        "held", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(classifier.HOLDOUT)) == 0).collect(), key=lambda x: x["doc_id"])
    y = np.array([np.nan if x["y"] is None else x["y"] for x in rows_])
    views = {v: np.array([x[v].toArray() for x in rows_]) for v in ("text_view", "meta_view")}
    views = {v: m[:, m.any(axis=0)] for v, m in views.items()}
    held = np.array([x["held"] for x in rows_]) & ~np.isnan(y)
    known = ~np.isnan(y) & ~held
    tally = {c: (y[known] == c).sum() for c in (0, 1)}
    weight = lambda t: np.where(t == 1, .5 / tally[1], .5 / tally[0]) * known.sum()
    fit = {v: newton(m[known], y[known], weight(y[known]), .003) for v, m in views.items()}
    odds = lambda v: views[v] @ fit[v][:-1] + fit[v][-1]
    for _ in range(classifier.ROUNDS):
        new = {}
        for v, other in (("meta_view", "text_view"), ("text_view", "meta_view")):
            z = odds(other)
            use = ~held & (known | (np.abs(z) >= np.log(.95 / .05)))
            t = np.where(known, y, z > 0)
            new[v] = newton(views[v][use], t[use], weight(t[use]), .003)
        fit = new
    def platt(z, y, w):         # the penalty is on the standardised margin
        mean = (w * z).sum() / w.sum()
        std = np.sqrt((w * (z - mean) ** 2).sum() / (w.sum() - (w * w).sum() / w.sum()))
        b = newton(z[:, None] / std, y, w, .001)
        return b[0] / std, b[1]
    cal = {v: platt(odds(v)[held], y[held], weight(y[held])) for v in views}
    t, u = (odds(v) * cal[v][0] + cal[v][1] for v in ("text_view", "meta_view"))
    want = {x["doc_id"]: 1 / (1 + np.exp(-(a + b) / 2)) for x, a, b in zip(rows_, t, u)}
    out = classifier.classify(d, lab)
    scores = [(r[0], r[1], r[2]) for r in out.select(f"{ROW}.doc_id", "score", "kept").collect()]
    assert len(scores) == 242 and out.select(f"{ROW}.*").columns[5:] == CLASH
    for i, s, kept in scores:
        assert kept == (s >= classifier.LIMIT)
        if i is not None:
            assert abs(s - want[i]) < 0.03, (i, s, want[i])


def test_classifier_without_both_classes(spark):
    lab = spark.createDataFrame([(0, 1), (1, 1), (2, 1)], "doc_id bigint, quality int")
    for labels in (lab, lab.limit(0)):
        out = classifier.classify(docs(spark, clash=True), labels)
        assert out.count() == len(rows()) and out.where("kept and score is null").count() == len(rows())
    both = lab.union(spark.createDataFrame([(3, 0), (4, 0), (5, 0)], "doc_id bigint, quality int"))
    assert classifier.classify(docs(spark, data=[]), both).count() == 0
    few = classifier.classify(docs(spark), both)            # a fold that may lack a class
    assert few.count() == len(rows())


# ---- 8 ------------------------------------------------------------------------
@pytest.mark.parametrize("length", [40, 400])
def test_suffix_dedup_brute(spark, length):
    data = rows()
    r = suffix.remove_repeats(docs(spark, clash=True), length=length)
    want = repeats([d[1] for d in data], length)
    out = got(r, f"{ROW}.doc_id", F.col("kept").cast("binary"), "n_removed", "n_spans")
    assert [(a, bytes(b), c, d) for a, b, c, d in out] == sorted([(d[0], *w) for d, w in zip(data, want)], key=repr) or \
        sorted((repr(a), bytes(b), c, d) for a, b, c, d in out) == sorted((repr(d[0]), *w) for d, w in zip(data, want))
    assert sum(w[1] for w in want) > 0
    assert suffix.remove_repeats(docs(spark, data=[]), length=length).count() == 0


def test_multikey_quicksort(monkeypatch):
    monkeypatch.setattr(suffix, "SMALL", 4)
    r = np.random.RandomState(2)
    keys = [r.randint(0, 5, 3000), r.randint(-9, 9, 3000), r.permutation(3000)]
    assert suffix.multikey_quicksort(keys).tolist() == np.lexsort(keys[::-1]).tolist()


def test_suffix_boundaries(spark):
    """Equal suffixes in different buckets are found at the boundary."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        data = [(i, f"{i:03d}" + "q" * 3 + "the same forty bytes of text, word for word." + f"{i * 7:04d}", "en", "s", 1) for i in range(30)]
        r = suffix.remove_repeats(docs(spark, data=data), length=40)
        want = repeats([d[1] for d in data], 40)
        assert got(r, "n_removed", "n_spans") == sorted([w[1:] for w in want], key=repr)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


# ---- 9 ------------------------------------------------------------------------
def test_warc_round_trip(spark):
    big, data = "é" * 700, [(1, "http://a/", "x"), (2, "http://b/\r\nWARC-Type: response", "é" * 700), (3, None, "é" * 700),
                            (4, "http://c/%0A", None), (5, "http://d/", ""), (6, "u", "WARC/1.1\r\n\r\n" * 200), (None, "u", "y"),
                            (7, "u", "x"), (3, None, "é" * 700)]
    p = spark.createDataFrame([(*d, "extra") for d in data], "page_id bigint, url string, html string, payload string")
    r = warc.archive(p)
    want = []
    for i, u, h in data:
        b = (h or "").encode()
        revisit = h == big and i == 2
        want.append(("revisit" if revisit else "response", None if i is None else str(i), u, hashlib.sha1(b).hexdigest(),
                     len(b), "3" if revisit else None, None if revisit else h or ""))
    assert got(r, "*") == sorted(want, key=repr)
    assert warc.archive(p.limit(0)).count() == 0


def test_warc_push_down(spark):
    p = spark.createDataFrame([(i, f"http://h{i}/", "z" * 1200 if i < 5 else f"page {i}") for i in range(40)],
                              "page_id bigint, url string, html string")
    path = common.scratch_path(spark, "warc-test")
    warc.write(p, path)
    r = warc.read(spark, path)
    some = r.where((F.col("record_type") == "revisit") & F.col("target_uri").isin("http://h2/", "http://h9/"))
    assert got(some, "record_id", "refers_to") == [("2", "4")]
    reader = warc.WarcReader(path, payload=False)
    from pyspark.sql.datasource import EqualTo, GreaterThan
    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_bytes",), 5)]))
    assert [type(f).__name__ for f in left] == ["GreaterThan"]
    out = [x for part in reader.partitions() for x in reader.read(part)]
    assert len(out) == 4 and all(x[-1] is None for x in out)
    assert warc.read(spark, path, payload=False).where("payload is not null").count() == 0


# ---- 10 -----------------------------------------------------------------------
@pytest.mark.parametrize("n,percent,small", [(3, 90, 64), (5, 80, 64), (2, 60, 3), (1, 50, 4)])
def test_jaccard_brute(spark, n, percent, small):
    data = [d for d in rows() if d[0] is not None]
    seen, uniq = set(), []
    for d in data:
        if d[0] not in seen:
            seen.add(d[0])
            uniq.append(d)
    want, sizes = components([d[1] for d in uniq], n, percent)
    c = jaccard.components(docs(spark, clash=True, data=uniq), n, percent, small)
    assert got(c, "doc_id", "n_shingles", "component_id") == sorted(
        [(d[0], s, uniq[w][0]) for d, w, s in zip(uniq, want, sizes)], key=repr)
    assert len(set(want)) < len(want)


def test_jaccard_large_regions_recur(spark):
    """A family of near copies around two centres, regions far beyond ``small``."""
    import random
    r = random.Random(5)
    base = [[f"w{r.randrange(10**6)}" for _ in range(60)] for _ in range(2)]
    base[1][:30] = base[0][:30]
    data = []
    for i in range(90):
        w = list(base[i % 2])
        for _ in range(r.randrange(1, 5)):
            w[r.randrange(30, 60)] = f"v{r.randrange(10**6)}"
        data.append((i, " ".join(w), "en", "s", 1))
    want, sizes = components([d[1] for d in data], 1, 90)
    c = jaccard.components(docs(spark, data=data), 1, 90, small=6)
    assert got(c, "doc_id", "component_id") == sorted([(d[0], w) for d, w in zip(data, want)], key=repr)
    assert 2 < len(set(want)) < 90


def test_near_duplicates_keep_one(spark):
    data = rows()
    kept = jaccard.near_duplicates(docs(spark, clash=True))
    want, sizes = components([d[1] for d in data], 5, 80)
    firsts = {data[w][0] for w, s in zip(want, sizes) if s}
    out = [r[0] for r in kept.where(F.col("text").rlike(r"[^\x20\x09-\x0D]") & F.col("doc_id").isNotNull()).select("doc_id").collect()]
    assert sorted(out) == sorted(x for x in firsts if x is not None)
    assert jaccard.near_duplicates(docs(spark, data=[])).count() == 0
    assert kept.columns[5:] == CLASH


# ---- long inputs, hot keys ------------------------------------------------------
def test_bpe_of_a_very_long_word():
    import random
    import time
    r, t = random.Random(9), library()
    long = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    some = [long, "x" + long[:70], "aaaa" * 40 + " the " + long[:200], "the" * 40, "é" * 500]
    c = bpe_codec.Codec(bpe.default_path())
    start = time.monotonic()
    out = bpe_codec.encode_many(c, some)
    assert time.monotonic() - start < 20
    for ids, e in zip(out, t.encode_batch(some, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids
    assert long not in c.known


def test_bpe_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe_codec, "MAX_CACHE", 3000)
    c, t = bpe_codec.Codec(bpe.default_path()), library()
    some = [" ".join(f"{a}{i}word" for i in range(40)) for a in "abcdefgh"]
    for ids, e in zip([bpe_codec.encode_many(c, [x])[0] for x in some], t.encode_batch(some, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids and c.held <= 3000


def test_codec_columns_agree(spark):
    d = docs(spark, clash=True)
    both = bpe_codec.encode_and_decode(d)
    ids = bpe_codec.encode(d)
    assert got(both, f"{ROW}.doc_id", "ids") == got(ids, f"{ROW}.doc_id", "ids")
    text = bpe_codec.decode_column(F.col("ids"), bpe.default_path())
    assert got(both, f"{ROW}.doc_id", "n_decoded") == got(ids.select(ROW, F.length(text).cast("long").alias("n")), f"{ROW}.doc_id", "n")
    null = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert got(null.select(text.alias("t")), "t") == [("",), (None,)]


def test_suffix_dedup_by_shuffles(spark, monkeypatch):
    """Nothing is broadcast but hot keys; texts are hashed in small blocks, and
    suffixes lie in many buckets."""
    monkeypatch.setattr(suffix, "MAX_BROADCAST", 0)
    monkeypatch.setattr(suffix, "BUCKET_ROWS", 64)
    monkeypatch.setattr(suffix, "BLOCK", 128)
    data = rows() + [(5000 + i, texts()[4], "en", "s", 1) for i in range(300)] + [(6000, texts()[4][:700] + " other end", "en", "s", 1)]
    r = suffix.remove_repeats(docs(spark, data=data), length=40)
    want = repeats([d[1] for d in data], 40)
    assert got(r, F.coalesce(f"{ROW}.doc_id", F.lit(-1)), F.hex("kept"), "n_removed", "n_spans") == sorted(
        [(-1 if d[0] is None else d[0], w[0].hex().upper(), *w[1:]) for d, w in zip(data, want)], key=repr)


def test_anchors_do_not_depend_on_blocks(monkeypatch):
    text = (" ".join(texts()) + "z" * 900).encode()
    whole = [x.tolist() for x in suffix.anchors(text, 40)]
    for block in (1, 7, 64, 4096):
        monkeypatch.setattr(suffix, "BLOCK", block)
        assert [x.tolist() for x in suffix.anchors(text, 40)] == whole
    assert suffix.anchors(b"short", 40)[0].tolist() == []


def test_joins_with_hot_keys(spark):
    d = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    n = common.store(d.groupBy("k").agg(F.count("*").alias("n")).where("n > 1 or k % 2 = 0"), "test-keys")
    semi = common.semi_join(d, n, ["k"], "n")
    assert got(semi, "id") == got(d.where("k % 2 = 0"), "id")
    side = spark.range(0, 9000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    left = common.left_join(d, side, "k")
    assert got(left, "id", "v") == got(d.select("id", F.expr("if(k % 2 = 0, k * 2, null)").alias("v")), "id", "v")


def test_warc_of_a_long_payload(spark):
    import time
    p = spark.range(1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("0123456789abcdef"), 4 << 20).alias("html"))
    path = common.scratch_path(spark, "warc-long")
    warc.write(p, path)
    reader = warc.WarcReader(path, payload=True)
    start = time.monotonic()
    out = [x for part in reader.partitions() for x in reader.read(part)]
    assert time.monotonic() - start < 20 and [len(x[-1]) for x in out] == [64 << 20]
