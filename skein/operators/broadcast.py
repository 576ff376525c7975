"""Size-checked broadcast: hint a join side as broadcast only when it is
proven small, else leave the join to a shuffle (with AQE skew handling)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

# A side is broadcast with at most this many rows and this many bytes, both
# counted: strings by their length, other columns and each row by FIXED.
MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 128 << 20
FIXED = 16


def fits(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether ``df`` (columns of single values) is within both bounds; reads
    at most ``max_rows`` + 1 rows."""
    size = F.lit(FIXED * (len(df.columns) + 1))
    for f in df.schema:
        if isinstance(f.dataType, StringType | BinaryType):
            size = size + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
    r = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(size.cast("long")).alias("b")).first()
    return r["n"] <= max_rows and (r["b"] or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` when it is within the bounds, else ``df``."""
    return F.broadcast(df) if fits(df, max_rows) else df
