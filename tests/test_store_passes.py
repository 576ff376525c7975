"""Passes of the stored index against the plain way."""
import random
from collections import Counter

from skein.sources import index_store

WORDS = ["pony", "Runs", "the", "Straße", "sky", "hopping", "x1"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bounds_are_summed_up_where_they_are_written(spark, tmp_path):
    rnd = random.Random(11)
    docs = [("s" if i % 5 else None, f"d{i % 60}", "", " ".join(rnd.choices(WORDS, k=i % 9)) if i % 7 else None) for i in range(80)]
    docs += [("t", f"e{i}", "", "pony sky" + " sky" * (i % 3)) for i in range(300)]
    index = index_store.build_and_store(spark.createDataFrame(docs, "site string, doc_key string, url string, text string"), str(tmp_path / "i"))
    most, n, df = {}, Counter(), Counter()
    for r in index["postings"].collect():
        key = (r["site"], r["term"], r["block"])
        most[key] = max(most.get(key, 0), r["tf"])
        n[key] += 1
        df[key[:2]] += 1
    got = {(r["site"], r["term"], r["block"]): (r["max_tf"], r["n"]) for r in index["bounds"].collect()}
    assert got == {k: (most[k], n[k]) for k in n} and index["bounds"].count() == len(n)
    assert {(r["site"], r["term"]): r["df"] for r in index["doc_freq"].collect()} == df
    # one exchange, by range: sums are written by the tasks that made them
    p = plan(index_store.bounds(index["postings"]))
    assert p.count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in p
