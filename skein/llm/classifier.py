"""Quality classifier by co-training of two views.

The text view sees hashed words of the text, the metadata view source,
language, length and layout.  Each round fits both on the labelled documents
and on the pseudo-labels that the other view was sure of, then labels anew the
whole unlabelled pool.  Both are calibrated on a held-out fold of the labelled
documents (Platt's logistic map of the margin), and the calibrated log-odds
are added for the score of every document.

Features and models are those of pyspark.ml: texts are read once, for feature
rows that are stored; models are fitted to those by distributed gradients and
applied to them within the JVM.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import FeatureHasher, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm import common

ROUNDS = 3
SURE = 0.95               # probability from which a pseudo-label is handed over
MAX_LABELLED = 20_000     # labelled documents a fit uses at most, about
HOLDOUT = 5               # one in so many labelled documents calibrates
TEXT_FEATURES = 1 << 14
META_FEATURES = 1 << 8
ITERATIONS = 25           # of one fit at most
LIMIT = 0.5


def pick(key: Column, buckets: int) -> Column:
    """A bucket of a document, the same in every run."""
    return F.pmod(F.xxhash64(key, F.lit("co-training")), F.lit(buckets))


def words(text: Column) -> Column:
    """The text as lower-case words of letters and single other marks, each
    kept once: what a text says, not how often."""
    return F.array_distinct(F.split(F.regexp_replace(F.lower(text), r"([^\p{L}\p{N}\s])", " $1 "), r"\s+"))


def views(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, terms, meta columns): the raw input of both views.  A null text
    is empty, null language and source are values of their own."""
    t = F.coalesce("text", F.lit(""))
    n = F.length(t)
    lines = F.size(F.split(t, "\n"))
    marks = n - F.length(F.regexp_replace(t, r"[^\p{L}\p{N}\s]+", ""))
    spaces = n - F.length(F.regexp_replace(t, r"\s+", ""))
    upper = F.length(F.regexp_replace(t, r"[^\p{Lu}]+", ""))
    share = lambda x: F.least(F.floor(20 * x / F.greatest(n, F.lit(1))), F.lit(19)).cast("string")
    return docs.select(
        *keys, words(t).alias("terms"),
        F.coalesce("lang", F.lit("\0")).alias("m_lang"), F.coalesce("source", F.lit("\0")).alias("m_source"),
        F.floor(F.log2(n + 1)).cast("string").alias("m_size"),
        F.floor(F.log2(n / lines + 1)).cast("string").alias("m_line"),
        share(marks).alias("m_marks"), share(spaces).alias("m_spaces"), share(upper).alias("m_upper"))


META = ["m_lang", "m_source", "m_size", "m_line", "m_marks", "m_spaces", "m_upper"]


def features(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text_view, meta_view) as sparse vectors."""
    tf = HashingTF(inputCol="terms", outputCol="text_view", numFeatures=TEXT_FEATURES, binary=True)
    fh = FeatureHasher(inputCols=META, outputCol="meta_view", numFeatures=META_FEATURES, categoricalCols=META)
    return fh.transform(tf.transform(views(docs, keys))).select(*keys, "text_view", "meta_view")


def _fit(rows: DataFrame, view: str):
    lr = LogisticRegression(featuresCol=view, labelCol="y", weightCol="w", regParam=0.003, maxIter=ITERATIONS,
                            standardization=False, probabilityCol="p", rawPredictionCol="m", predictionCol="c")
    return lr.fit(rows)


def margin(model, df: DataFrame, view: str, name: str) -> DataFrame:
    """``df`` with the model's log-odds as ``name``."""
    out = model.transform(df.withColumn("__v", F.col(view)))
    return out.withColumn(name, vector_to_array("m")[1]).drop("m", "p", "c", "__v")


class CoTrained:
    """Two fitted views with their calibration (slope, intercept)."""

    def __init__(self, text, meta, cal):
        self.text, self.meta, self.cal = text, meta, cal

    def score(self, feats: DataFrame) -> DataFrame:
        """``feats`` with text_score, meta_score and score, rounded so that the
        order of sums in a fit cannot show."""
        out = margin(self.meta, margin(self.text, feats, "text_view", "t"), "meta_view", "u")
        (a, b), (c, d) = self.cal
        p = lambda z: F.round(1 / (1 + F.exp(-z)), 4)
        t, u = F.col("t") * a + b, F.col("u") * c + d
        return out.select("*", p(t).alias("text_score"), p(u).alias("meta_score"),
                          p((t + u) / 2).alias("score")).drop("t", "u")


def _calibrate(rows: DataFrame, view: str, model) -> tuple[float, float]:
    """Platt's map, fitted to the margins of the held-out fold; the margins as
    they are where the fold does not hold both classes."""
    m = margin(model, rows, view, "z").select("y", "w", F.array("z").alias("z"))
    if m.select("y").distinct().count() < 2:
        return 1.0, 0.0
    from pyspark.ml.functions import array_to_vector
    fit = LogisticRegression(featuresCol="v", labelCol="y", weightCol="w", regParam=0.001).fit(
        m.select("y", "w", array_to_vector("z").alias("v")))
    return float(fit.coefficients[0]), float(fit.intercept)


class OneClass(ValueError):
    """There are no labelled documents of both classes to learn from."""


def labelled_sample(labels: DataFrame, max_labelled: int) -> tuple[DataFrame, float]:
    """(doc_id, y) of about ``max_labelled`` labels at most, picked by a hash
    of doc_id, and their share of all.  Labels that are null or contradict
    each other, and ids that are null, are left out."""
    lab = (labels.where("doc_id is not null and y is not null").groupBy("doc_id")
           .agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").select("doc_id", F.col("y").cast("double")))
    lab = common.store(lab, "co-labels")
    share = min(1.0, max_labelled / max(lab.count(), 1))
    return lab.where(pick(F.col("doc_id"), 1 << 20) < F.lit(int(share * (1 << 20)))), share


def feature_rows(docs: DataFrame, lab: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, doc_id, y, text_view, meta_view) of every row of ``docs``,
    stored.  The labels, a bounded sample, go to the rows: no text is moved."""
    feats = features(docs, [*keys, "doc_id"]).join(F.broadcast(lab), "doc_id", "left")
    return common.store(feats.select(*keys, "doc_id", "y", "text_view", "meta_view"), "co-features")


def co_train(feats: DataFrame, share: float = 1.0, rounds: int = ROUNDS) -> CoTrained:
    """Fit on stored ``feature_rows``.

    The labelled rows weigh as much as all labelled documents, of which they
    are ``share``, so that their balance with the pool does not depend on the
    size of the table.  The pool is every other document with a doc_id: all
    are scored in each round, and every sure pseudo-label is handed over.
    Without labels of both classes there is nothing to tell apart: OneClass.
    """
    feats = feats.where("doc_id is not null")
    labelled = F.col("y").isNotNull()
    held = labelled & (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(HOLDOUT)) == 0)
    train = feats.where(labelled & ~held)
    tally = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}      # a row a class
    if set(tally) != {0.0, 1.0}:
        raise OneClass("labels of both classes are needed")
    weigh = lambda df, of=F.lit(1.0): df.withColumn("w", of * F.when(F.col("y") == 1, 0.5 / tally[1.0]).otherwise(0.5 / tally[0.0]) * sum(tally.values()))
    sure = F.lit(SURE / (1 - SURE))
    models = {v: _fit(weigh(train), v) for v in ("text_view", "meta_view")}
    for _ in range(rounds):
        given = {}
        for view, other in (("meta_view", "text_view"), ("text_view", "meta_view")):   # each learns from the other
            z = margin(models[other], feats.where(~held), other, "z").where(labelled | (F.exp(F.abs("z")) >= sure))
            z = z.withColumn("of", F.when(labelled, 1 / share).otherwise(1.0))
            z = z.withColumn("y", F.coalesce("y", (F.col("z") > 0).cast("double")))
            given[view] = weigh(z, F.col("of"))
        models = {v: _fit(given[v], v) for v in given}
    fold = weigh(feats.where(held))
    cal = [_calibrate(fold, v, models[v]) for v in ("text_view", "meta_view")]
    return CoTrained(models["text_view"], models["meta_view"], cal)


def classify(docs: DataFrame, labels: DataFrame, limit: float = LIMIT, carry: list[str] | None = None,
             max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(__row, text_score, meta_score, score, kept) for every row of ``docs``;
    ``labels`` are (doc_id, quality), of which about ``max_labelled`` at most
    are used.

    A null or empty text is scored by its metadata and an empty text view; a
    row without doc_id is scored, too, but not learnt from.  Repeated rows
    score alike, and a score that equals ``limit`` is kept.  Very long texts
    are read whole.  Without labelled documents of both classes (an empty
    table of labels, say) all scores are null and all rows kept; an empty
    table of documents gives no rows.
    """
    lab, share = labelled_sample(labels.select("doc_id", F.col("quality").alias("y")), max_labelled)
    every = docs.select(common.pack(docs.select(carry or docs.columns)), "doc_id", "text", "lang", "source")
    feats = feature_rows(every, lab, [common.ROW])
    try:
        out = co_train(feats, share).score(feats).withColumn("kept", F.col("score") >= limit)
    except OneClass:
        none = F.lit(None).cast("double")
        out = feats.withColumns({"text_score": none, "meta_score": none, "score": none, "kept": F.lit(True)})
    return out.select(common.ROW, "text_score", "meta_score", "score", "kept")
