"""Scans of the input tables with fixed schemas (no inference).

Column pruning and filter pushdown are left to Catalyst: every caller selects
only what it uses, and the Parquet scan reads only those columns.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from skein import schemas

TABLE_SCHEMAS = {
    "pages": schemas.PAGES,
    "documents": schemas.DOCUMENTS,
    "benchmark": schemas.BENCHMARK,
    "conversations": schemas.CONVERSATIONS,
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = os.path.join(sf_dir, f"{name}.parquet")
    schema = TABLE_SCHEMAS.get(name)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def pages(spark, sf_dir):
    return read_table(spark, sf_dir, "pages")


def documents(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


def benchmark(spark, sf_dir):
    return read_table(spark, sf_dir, "benchmark")


def conversations(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations")


def is_missing(e: AnalysisException) -> bool:
    """Whether a read failed because nothing lies at the path; any other
    failure must not pass for an empty table."""
    return e.getCondition() == "PATH_NOT_FOUND"
