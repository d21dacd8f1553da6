"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 100_000
MAX_BROADCAST_BYTES = 32 << 20


def _bytes_of_row(df: DataFrame) -> Column:
    """Bytes of texts and binaries as they are, of everything else as text."""
    parts = [F.octet_length(F.col(f"`{f.name}`").cast("string") if f.dataType.simpleString() not in ("string", "binary")
                            else F.col(f"`{f.name}`")) for f in df.schema if f.dataType.simpleString().partition("<")[0] not in ("map", "variant")]
    return sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(16)).cast("bigint")


def fits(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """True when `df` has at most `max_rows` rows and `max_bytes`; reads no further than the rows."""
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(_bytes_of_row(df))).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint when it is small, else untouched.

    Untouched means a shuffled join, whose hot keys adaptive execution splits.
    """
    return F.broadcast(df) if fits(df, max_rows) else df
