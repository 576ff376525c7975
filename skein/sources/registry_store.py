"""Registry storage (S9): each change writes a new snapshot version of the
``sites`` and ``site_keys`` tables, then a marker in ``commits``; reads take
the newest version that has its marker, so both tables come from one save and
a half-failed one is not seen.  Saving a version again replaces it."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import schemas
from skein.sources.tables import is_missing


COMMITS = "version bigint, saved_at timestamp"


def newest_version(spark: SparkSession, root: str) -> int | None:
    try:
        commits = spark.read.schema(COMMITS).parquet(os.path.join(root, "commits"))
    except AnalysisException as e:
        if not is_missing(e):
            raise
        return None
    return commits.agg(F.max("version")).first()[0]


def load(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    newest = newest_version(spark, root)
    out = {}
    for name, schema in (("sites", schemas.SITES), ("site_keys", schemas.SITE_KEYS)):
        if newest is None:
            out[name] = spark.createDataFrame([], schema)
        else:
            out[name] = spark.read.schema(schema).parquet(os.path.join(root, name, f"version={newest}"))
    return out


def save(sites: DataFrame, site_keys: DataFrame, root: str, version: int) -> None:
    for name, df in (("sites", sites), ("site_keys", site_keys)):
        df.write.mode("overwrite").parquet(os.path.join(root, name, f"version={version}"))
    marker = sites.sparkSession.range(1).select(F.current_timestamp().alias("saved_at"))
    marker.write.mode("overwrite").parquet(os.path.join(root, "commits", f"version={version}"))
