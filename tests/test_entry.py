import __spark_entry__ as E
from pyspark.sql import functions as F

from conftest import SF_SMALL
from skein.operators import index as ix
from skein.plans import catalog


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["query_id", "rank", "doc_key", "url", "score", "no_of_docs"]
    assert df.count() > 0


def test_every_query_has_an_oracle_or_is_listed():
    missing = {k for k in set(E.queries()) - set(E.oracle_sql()) if not k.startswith("op")} - {"pipeline"}
    assert not missing


def test_index_invariants(spark):
    docs = catalog.docs_by_source(spark, SF_SMALL)
    post = ix.term_freq(docs)
    dfreq = ix.doc_freq(post)
    n = ix.doc_count(docs)
    from skein.operators.analyze import index_terms
    assert post.agg(F.sum("tf")).first()[0] == index_terms(docs).count()
    bad = dfreq.join(n, "site").where((F.col("df") < 1) | (F.col("df") > F.col("n"))).count()
    assert bad == 0
    assert post.groupBy("site", "term").count().exceptAll(
        dfreq.withColumnRenamed("df", "count")).count() == 0
