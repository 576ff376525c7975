"""Counting by slices of texts: the terms of a token are worked out once, a
page counts as one wherever it is cut."""
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.functions.stem import SUFFIXES, PyOps, porter_stages, stemmer
from skein.operators import analyze
from skein.operators import index as ix
from skein.streaming import incremental


@pytest.fixture
def fresh(monkeypatch):
    monkeypatch.setattr(analyze, "KNOWN", {})
    return monkeypatch


def batches(rows, size):
    t = pa.table({"site": pa.array([r[0] for r in rows], pa.string()), "doc_key": pa.array([r[1] for r in rows], pa.string()),
                  "text": pa.array([r[2] for r in rows], pa.string())})
    return t.to_batches(max_chunksize=size)


def counts(rows, size, stopwords=None):
    out = Counter()
    for b in analyze.counted(batches(rows, size), ("site", "doc_key"), stopwords):
        for r in b.to_pylist():
            key = (r["site"], r["doc_key"], r["term"])
            assert key not in out               # one row a page and term
            out[key] = r["tf"]
    return out


def test_words_in_use_stay_known_however_many_others_come(fresh):
    """A worker's memory was emptied when it was full, and
    all words had to be stemmed anew."""
    asked, rule = Counter(), analyze.term_of_token

    def counting(stopwords):
        term = rule(stopwords)

        def told(token):
            asked[token] += 1
            return term(token)
        return told
    fresh.setattr(analyze, "term_of_token", counting)
    fresh.setattr(analyze, "TOKENS_KEPT", 20)
    letters = "abcdefghij"
    rows = [("s", str(i), f"common {letters[i // 10]}{letters[i % 10]}x") for i in range(100)]
    counts(rows, 1)
    assert asked["common"] == 1 and sum(asked.values()) == 101


@pytest.mark.parametrize("slice_bytes", [1, 9, 1 << 20])
@pytest.mark.parametrize("size", [1, 3, 100])
def test_a_page_counts_as_one_wherever_it_is_cut(fresh, slice_bytes, size):
    fresh.setattr(analyze, "SLICE_BYTES", slice_bytes, raising=False)
    rows = [(None, None, "Cats"), (None, None, "cat x1 dog"), (None, "1", None), (None, "1", ""), ("s", None, "dog"),
            ("s", "1", "running runs"), ("s", "1", None), ("s", "1", "run"), ("s", "2", None), ("s", "3", "run Straße")]
    assert counts(rows, size) == Counter({
        (None, None, "cat"): 2, (None, None, "dog"): 1, ("s", None, "dog"): 1, ("s", "1", "run"): 3,
        ("s", "3", "run"): 1, ("s", "3", "strass"): 1})


def test_words_without_a_suffix_of_the_rules_are_left_as_they_are():
    """The short way of the stemmer gives what the rules give."""
    for nltk, irregular in ((True, False), (True, True), (False, False)):
        stages = [st for parts in porter_stages(PyOps(), "word", nltk, irregular) for st in parts]
        stem = stemmer(nltk, irregular)
        words = [a + b + c for a in ("", "b", "sk", "aba", "canni", "Y") for b in ("", "o", "yt", "LOG") for c in (*SUFFIXES, "a", "ö", "h", "Q")]
        for word in [*words, "sky", "dying", "news", "howe", "inning"]:
            row = {"word": word}
            for name, rule in stages:
                row[name] = rule(row)
            assert stem(word) == row["__w"], word


def test_superseded_pages_are_looked_up_once(spark, tmp_path, monkeypatch):
    """each table of a compaction looked the superseded pages up anew."""
    out = str(tmp_path / "out")
    for i, text in enumerate(("cat dog", "cat bird")):
        batch = spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id bigint, text string, lang string, source string, n_chars bigint")
        incremental.write_batch(batch, i, out, "documents", None, None)
    made = []
    monkeypatch.setattr(incremental, "materialize", lambda df, name, put=incremental.materialize: made.append(name) or put(df, name))
    incremental.compact(spark, out)
    assert made == ["superseded"]
    found = incremental.current_index(spark, out)
    assert sorted((r["term"], r["df"]) for r in found["doc_freq"].collect()) == [("bird", 1), ("cat", 1)]
    assert [r["text"] for r in found["docs"].collect()] == ["cat bird"]


ODD_DOCS = [("a", "1", "cats cat dog"), ("a", "1", "cat run"), ("b", "1", "cat x1"), ("b", None, "dog"), ("b", None, "dogs"),
            (None, "1", "cat"), (None, None, None), ("a", "2", ""), ("a", "3", "dog running")]


def test_pages_of_a_term_are_counted_where_its_postings_are_made(spark, monkeypatch):
    """term_weights sent each posting to the JVM, to be counted there."""
    docs = spark.createDataFrame([(s, k, k, t) for s, k, t in ODD_DOCS], "site string, doc_key string, url string, text string")
    index = ix.build_index(docs, stopwords=None)
    one_by_one = ix.doc_freq(ix.term_freq(docs, stopwords=None))
    assert sorted(map(str, index["doc_freq"].collect())) == sorted(map(str, one_by_one.collect()))
    assert index["doc_freq"].columns == one_by_one.columns
    counting = [x for x in plan(index["doc_freq"]).splitlines() if "MapInArrow" in x]
    assert counting and not any("tf#" in x for x in counting)


@pytest.mark.parametrize("held", [1, 3, 1 << 20])
@pytest.mark.parametrize("size", [1, 4, 100])
def test_pages_held_are_handed_on(fresh, held, size):
    fresh.setattr(analyze, "PAGES_HELD", held)
    rows = sorted(ODD_DOCS, key=lambda r: [(x is not None, x or "") for x in r[:2]])
    got = Counter()
    for b in analyze.pages_counted(batches(rows, size), None):
        for r in b.to_pylist():
            got[r["site"], r["term"]] += r["df"]
    assert got == Counter((s, t) for s, _, t in counts(rows, 100))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pages_are_formed_as_their_postings_stream_by(spark):
    """F16: postings_json gathered all postings of a task in lists, by sorting
    them, and moved them by a shuffle of their own."""
    docs = spark.createDataFrame([(s, k, k, t) for s, k, t in ODD_DOCS], "site string, doc_key string, url string, text string")
    post = ix.term_freq(docs, stopwords=None)
    gathered = {(r.site, r.doc_key): r.e for r in post.groupBy("site", "doc_key").agg(
        F.to_json(F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("tf")).alias("n"), "term", "tf"))),
                                                 lambda x: F.struct(x["term"], x["tf"])))).alias("e")).collect()}
    streamed = ix.postings_map(post, by_page=True)
    for df in (streamed, ix.postings_map(post), ix.postings_map(post.repartition(5))):
        got = df.select("site", "doc_key", F.to_json("terms").alias("e")).collect()
        assert len(got) == len(gathered) and {(r.site, r.doc_key): r.e for r in got} == gathered
        assert "collect_list" not in plan(df)
    assert plan(streamed).count("Repartition") == 1         # that of the texts


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_a_page_is_formed_once_wherever_its_postings_are_cut(size):
    post = [("a", "1", "y", 1), ("a", "1", "é", 2), ("a", "1", "z", 2), ("a", "2", "z", 1), (None, "2", "z", 5), (None, None, "b", 1),
            (None, None, "a", 1), (None, None, "c", 9)]
    t = pa.table({n: pa.array([r[i] for r in post], pa.int64() if n == "tf" else pa.string())
                  for i, n in enumerate(("site", "doc_key", "term", "tf"))})
    got = [(r["site"], r["doc_key"], [(e["term"], e["tf"]) for e in r["e"]])
           for b in analyze.page_forms(t.to_batches(max_chunksize=size), 2) for r in b.to_pylist()]
    assert got == [("a", "1", [("z", 2), ("é", 2), ("y", 1)]), ("a", "2", [("z", 1)]), (None, "2", [("z", 5)]),
                   (None, None, [("c", 9), ("a", 1), ("b", 1)])]
