"""How filters interact: what each removes in every order of applying them.

A row of the mask matrix says which filters a kind of document fails (0 where
it fails, infinity where it passes); a row of the position matrix says at
which step an order applies each filter, the inverse of the permutation.
Their min-plus product is the step at which the order removes the document:
the least position among the filters that it fails.  Document counts, summed
up per part and mask beforehand, are scattered by that step.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm import common

WORD_GAP = r"[\x20\x09-\x0D]+"
MAX_FILTERS = 7           # orders are the factorial of the filters
COPIES = "E"              # the filter of repeated texts

SCHEMA = ("part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
          "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint")


def words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of a text that is not null."""
    return {
        "A": F.size("__w") < 100,
        "B": F.size(F.array_distinct("__w")) * 100 < F.size("__w") * 80,
        "C": (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) * 100 > F.length(text) * 10,
        "D": text.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, fails, n): the sorted letters of the filters that each
    document fails, and the rows that are alike in all of that.

    Repeats are settled without joining the copies of a text: the least doc_id
    of each text is a grouped minimum (combined before the shuffle), and a
    document passes if it is that one, which is a join on (doc_id, text)."""
    t = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), t.alias("__t"), words(t).alias("__w"))
    letters = [F.when(c, x).otherwise("") for x, c in text_filters(F.col("__t")).items()]
    d = d.select("doc_id", "part", F.unhex(F.md5(F.col("__t").cast("binary"))).alias("digest"),
                 F.concat(*letters).alias("fails"))
    rows = common.store(d.groupBy(*d.columns).agg(F.count("*").alias("n")), "audit-rows")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    rows = rows.join(first.withColumn("first", F.lit(True)), ["doc_id", "digest"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.select("doc_id", "part", F.concat("fails", F.when(copy, COPIES).otherwise("")).alias("fails"), "n")


def removal_steps(masks: np.ndarray, position: np.ndarray) -> np.ndarray:
    """The min-plus product of masks (kinds x filters, 0 or infinity) and
    positions (orders x filters): kinds x orders, infinity where kept."""
    out = np.full((len(masks), len(position)), np.inf)
    for f in range(masks.shape[1]):
        np.minimum(out, masks[:, f, None] + position[None, :, f], out=out)
    return out


def scatter(fails: list[str], weights: np.ndarray, letters: str) -> dict[str, np.ndarray]:
    """Counts (orders x steps) for kinds of documents that fail the letters of
    ``fails``; ``weights`` (kinds x 3): all, good, toxic documents."""
    orders = np.array(list(itertools.permutations(range(len(letters)))))
    position = np.argsort(orders, axis=1)
    failing = np.array([[x in f for x in letters] for f in fails], bool).reshape(len(fails), len(letters))
    step = removal_steps(np.where(failing, 0.0, np.inf), position)
    kind, order = np.nonzero(np.isfinite(step))
    lost = np.zeros((*orders.shape, 3), np.int64)
    np.add.at(lost, (order, step[kind, order].astype(np.int64)), weights[kind])
    removed = lost[:, :, 0]
    total = failing.T.astype(np.int64) @ weights[:, 0]
    alone = (failing & (failing.sum(axis=1) == 1)[:, None]).T.astype(np.int64) @ weights[:, 0]
    worth = np.take_along_axis(removed, position, axis=1).sum(axis=0)
    return {"kept": weights[:, 0].sum() - np.cumsum(removed, axis=1), "removed": removed,
            "redundant": total[orders] - removed, "unique_fails": alone[orders],
            "good_lost": lost[:, :, 1], "toxic_lost": lost[:, :, 2], "shapley": worth[orders]}


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """SCHEMA: for each part (lang; null as empty) of ``docs``, each order of
    the filters and each step, the counts after and at that step, and the
    filter's share over all orders.  ``labels``: (doc_id, quality, toxic).

    A null text is empty.  A null doc_id is neither smaller nor larger than
    another, so such a row is no copy and makes none, and it has no label.
    Rows that repeat a doc_id with the same text are no copies of each other.
    Of several labels of one doc_id, one that says good or toxic counts.  Very
    long texts are read whole; an empty table gives no rows; without labels
    nothing is good or toxic.
    """
    common.prepare(docs.sparkSession)
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = failures(docs.select("doc_id", "text", "lang")).join(said, "doc_id", "left")
    of = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0)))
    kinds = rows.groupBy("part", "fails").agg(F.sum("n").alias("n"), of("good").alias("good"), of("toxic").alias("toxic"))
    letters = "".join(text_filters(F.lit(""))) + COPIES
    if len(letters) > MAX_FILTERS:
        raise ValueError(letters)

    def count(table: pa.Table) -> pa.Table:     # at most 2^filters rows of one part
        weights = np.stack([table[c].to_numpy() for c in ("n", "good", "toxic")], axis=1).astype(np.int64)
        got = scatter(table["fails"].to_pylist(), weights, letters)
        orders = ["".join(o) for o in itertools.permutations(letters)]
        k = len(letters)
        cols = [pa.array([table["part"][0].as_py()] * (k * len(orders))), pa.array([o for o in orders for _ in range(k)]),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)))]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        return pa.table(cols + [pa.array(got[c].ravel()) for c in names[3:]], names=names)
    return kinds.groupBy("part").applyInArrow(count, SCHEMA)
