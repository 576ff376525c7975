"""Signed deltas, replay, compaction, observed counts; W2."""
import os

import pytest

from skein.operators import index as ix
from skein.streaming import incremental
from test_plans import plan_of

PAGES = "page_id bigint, url string, html string"


def feed(spark, tmp_path, src, name, rows):
    d = tmp_path / ("part-" + name)
    spark.createDataFrame(rows, PAGES).coalesce(1).write.parquet(str(d))
    src.mkdir(exist_ok=True)
    for f in os.listdir(d):
        if f.endswith(".parquet"):
            os.link(d / f, src / f"{name}-{f}")


def tables(index):
    cols = {"docs": ("doc_key", "text"), "postings": ("doc_key", "term", "tf"), "doc_freq": ("term", "df"), "doc_count": ("n",)}
    return {k: sorted(tuple(r[c] for c in v) for r in index[k].collect()) for k, v in cols.items()}


def rebuilt(spark, rows):
    last = {u: (i, u, h) for i, u, h in rows if h is not None}
    return tables(ix.build_index(ix.docs_from_pages(spark.createDataFrame(list(last.values()), PAGES))))


BATCHES = [[(1, "https://h/a", "<p>alpha beta</p>"), (2, "https://h/b", "<p>beta</p>"), (3, "https://h/x", None)],
           [(1, "https://h/a", "<p>gamma beta beta</p>"), (4, "https://h/c", "<p>2024</p>")],
           [(2, "https://h/b", "<p>9 9</p>"), (1, "https://h/a", "<p>alpha</p>")]]


def test_deltas_equal_a_rebuild(spark, tmp_path):
    src, out, seen = tmp_path / "src", str(tmp_path / "out"), []
    for i, rows in enumerate(BATCHES):
        feed(spark, tmp_path, src, str(i), rows)
        seen += rows
        got = incremental.run_index_stream(spark, str(src), out)
        failed = sum(r[2] is None for r in rows)
        assert got == [{"fetched": len(rows) - failed, "failed": failed, "total": len(rows)}]
        assert tables(incremental.current_index(spark, out)) == rebuilt(spark, seen)
        if i == 1:
            incremental.compact(spark, out)
            incremental.compact(spark, out)             # nothing new: nothing to do
            assert tables(incremental.current_index(spark, out)) == rebuilt(spark, seen)
    v = incremental.Versions(spark, out)
    assert (v.base, v.last, v.later) == (1, 2, [2])
    # a page that lost a term takes it from the count, and one that kept it does not
    delta = {(r.term, r.df) for r in v.table("df_delta").where("version = 2").collect()}
    assert {("alpha", 1), ("gamma", -1), ("beta", -2)} == delta


def test_a_batch_counts_only_once(spark, tmp_path, monkeypatch):
    """A batch that fails before its marker is not seen; its replay writes the
    same folders, and its counts are those of one run."""
    src, out = tmp_path / "src", str(tmp_path / "out")
    feed(spark, tmp_path, src, "0", BATCHES[0])
    incremental.run_index_stream(spark, str(src), out)
    feed(spark, tmp_path, src, "1", BATCHES[1])
    with monkeypatch.context() as m:
        def broken(*a):
            raise RuntimeError("the driver is lost")
        m.setattr(incremental, "_mark", broken)
        with pytest.raises(Exception, match="driver is lost"):
            incremental.run_index_stream(spark, str(src), out)
    assert tables(incremental.current_index(spark, out)) == rebuilt(spark, BATCHES[0])
    assert incremental.run_index_stream(spark, str(src), out) == [{"fetched": 2, "failed": 0, "total": 2}]
    assert tables(incremental.current_index(spark, out)) == rebuilt(spark, BATCHES[0] + BATCHES[1])
    rows = [tuple(r) for r in incremental.stored_progress(spark, out).orderBy("version").collect()]
    assert rows == [(0, 2, 1, 3), (1, 2, 0, 2)]
    # and one that is written again after its marker changes nothing
    listed = spark.createDataFrame(BATCHES[1], PAGES)
    incremental.write_batch(listed, 1, out, "pages", None, "nltk")
    assert tables(incremental.current_index(spark, out)) == rebuilt(spark, BATCHES[0] + BATCHES[1])


def test_empty_output(spark, tmp_path):
    got = incremental.current_index(spark, str(tmp_path / "none"))
    assert all(df.count() == 0 for df in got.values())
    assert incremental.stored_progress(spark, str(tmp_path / "none")).count() == 0
    incremental.compact(spark, str(tmp_path / "none"))


def test_latest_versions_leave_texts_alone(spark):
    rows = [("s", f"k{i}", v, f"text {i} {v}") for i in range(20) for v in range(1 + i % 3)]
    versions = spark.createDataFrame(rows, "site string, doc_key string, version int, text string")
    latest = ix.latest_versions(versions)
    assert sorted((r.doc_key, r.version, r.text) for r in latest.collect()) == sorted(
        (f"k{i}", i % 3, f"text {i} {i % 3}") for i in range(20))
    plan = plan_of(latest)
    assert "SortAggregate" not in plan
    moved = [x for x in plan.split("\n") if "Exchange" in x and "text" in x]
    assert not moved
