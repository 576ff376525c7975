import json
import os
from urllib.parse import quote

from pyspark.sql import functions as F

from skein.operators import index as ix
from skein.sources import bundle, index_store
from skein.streaming import incremental

F1 = {"https://h/a": {"cat": 2, "run": 1, "dog": 1}, "https://h/b": {"dog": 1, "thi": 1}, "https://h/c": {}}


def test_f8_bundle_round_trip(spark, tmp_path):
    root = tmp_path / "bundle"
    for d in ("index", "data"):
        (root / d).mkdir(parents=True)
    for url, tf in F1.items():
        name = quote(url, safe="")[:201]
        (root / "index" / name).write_text(json.dumps(tf))
        (root / "data" / name).write_text("text of " + url)
    (root / "doc_freq").write_text(json.dumps({"cat": 1, "run": 1, "dog": 2, "thi": 1}))
    idx = bundle.import_bundle(spark, str(root), "s")
    post = {(r.doc_key, r.term): r.tf for r in idx["postings"].collect()}
    assert post == {(quote(u, safe=""), t): n for u, tf in F1.items() for t, n in tf.items()}
    assert idx["doc_count"].first().n == 3
    assert sorted(r.url for r in idx["docs"].collect()) == sorted(F1)
    rows = bundle.export_rows(idx, "s")
    back = {r.doc_key: json.loads(r.json) for r in rows["index"].collect()}
    assert back == {quote(u, safe=""): tf for u, tf in F1.items()}


def test_index_store_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("s1", "k1", "k1", "cats running"), ("s2", "k2", "k2", "dog")],
                                 "site string, doc_key string, url string, text string")
    idx = ix.build_index(docs)
    index_store.write_index(idx, str(tmp_path / "idx"))
    back = index_store.read_index(spark, str(tmp_path / "idx"), site="s1")
    assert sorted((r.term, r.tf) for r in back["postings"].collect()) == [("cat", 1), ("run", 1)]
    missing = index_store.read_table(spark, str(tmp_path / "nothing"), "doc_freq")
    assert missing.count() == 0


def test_stream_equals_batch(spark, tmp_path):
    pages = [(1, "https://h/a", "<p>cats running</p>"), (2, "https://h/b", "<p>dog days</p>"),
             (1, "https://h/a", "<p>dogs only</p>")]          # page a re-crawled later
    src = tmp_path / "src"
    for i, p in enumerate(pages):
        spark.createDataFrame([p], "page_id bigint, url string, html string") \
             .coalesce(1).write.parquet(str(src / f"batch{i}"))
    flat = tmp_path / "flat"
    flat.mkdir()
    for i in range(len(pages)):
        d = src / f"batch{i}"
        for f in os.listdir(d):
            if f.endswith(".parquet"):
                os.link(d / f, flat / f"{i:03d}-{f}")
    out = tmp_path / "out"
    progress = incremental.run_index_stream(spark, str(flat), str(out), kind="pages",
                                            checkpoint=str(tmp_path / "ckpt"))
    assert progress == [{"fetched": 1, "failed": 0, "total": 1}] * 3
    cur = incremental.current_index(spark, str(out))
    got = sorted((r.term, r.df) for r in cur["doc_freq"].collect())
    final = spark.createDataFrame(pages[1:], "page_id bigint, url string, html string")
    expect = sorted((r.term, r.df) for r in ix.doc_freq(ix.term_freq(ix.docs_from_pages(final))).collect())
    assert got == expect
    assert cur["doc_count"].first().n == 2


def test_stream_goes_on_and_counts_a_page_once(spark, tmp_path):
    """A second run without a named checkpoint adds to the first; a page twice
    in one batch counts once."""
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()

    def put(name, rows):
        d = tmp_path / name
        spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(str(d))
        for f in os.listdir(d):
            if f.endswith(".parquet"):
                os.link(d / f, src / f"{name}-{f}")

    put("a", [(1, "https://h/a", "<p>alpha</p>"), (1, "https://h/a", "<p>alpha</p>"), (2, "https://h/b", "<p>beta</p>")])
    assert incremental.run_index_stream(spark, str(src), out) == [{"fetched": 3, "failed": 0, "total": 3}]
    put("b", [(3, "https://h/c", "<p>gamma</p>")])
    assert incremental.run_index_stream(spark, str(src), out) == [{"fetched": 1, "failed": 0, "total": 1}]
    cur = incremental.current_index(spark, out)
    assert sorted((r.term, r.tf) for r in cur["postings"].collect()) == [("alpha", 1), ("beta", 1), ("gamma", 1)]
    assert cur["doc_count"].first().n == 3


def test_export_is_imported_again(spark, tmp_path):
    docs = spark.createDataFrame([("s", "https%3A%2F%2Fh%2Fa", "https://h/a", "cats running cats"),
                                  ("s", "https%3A%2F%2Fh%2Fb", "https://h/b", "dog cat"),
                                  ("s", "https%3A%2F%2Fh%2Fc", "https://h/c", "")],
                                 "site string, doc_key string, url string, text string")
    idx = ix.build_index(docs)
    bundle.export_bundle(idx, "s", str(tmp_path / "out"))
    back = bundle.import_export(spark, str(tmp_path / "out"), "s")
    for name in ("docs", "postings", "doc_freq", "doc_count"):
        want = [tuple(r) for r in idx[name].collect()]
        assert sorted(tuple(r) for r in back[name].select(*idx[name].columns).collect()) == sorted(want), name
