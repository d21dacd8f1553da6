"""Keep-first dedup, idempotent re-runs, high-water scans and file gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _with_own_key(events: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """Rows without a key get one of their own: they match nothing and do not pile up in one task."""
    own = F.concat(F.lit("\u0000"), *[F.concat(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\u0000"))
                                      for c in order])
    return events.withColumn("__key", F.coalesce(F.col(key), own))


def keep_first(events: DataFrame, key: str = "dedup_key", scope: tuple[str, ...] = ("agent",),
               order: tuple[str, ...] = ("source_file", "line_start", "line_seq")) -> DataFrame:
    """The first row of every key over all files; rows without a key are never duplicates.

    One pass. Spark turns the row_number filter into a group limit on the map side,
    so a key re-logged in a third of all rows leaves each map task as one row.
    `order` is unique per row.
    """
    first = Window.partitionBy(*scope, "__key").orderBy(*order)
    return (_with_own_key(events, key, order).withColumn("__n", F.row_number().over(first))
            .filter(F.col("__n") == 1).drop("__n", "__key"))


def not_yet_stored(events: DataFrame, stored_keys: DataFrame, key: str = "dedup_key",
                   scope: tuple[str, ...] = ("agent",),
                   order: tuple[str, ...] = ("source_file", "line_start", "line_seq")) -> DataFrame:
    """Events whose key an earlier run has not stored; unkeyed events pass."""
    stored = stored_keys.select(*scope, F.col(key).alias("__key"))
    return (_with_own_key(events, key, order).join(stored, [*scope, "__key"], "left_anti")
            .select(events.columns))


def above_mark(rows: DataFrame, mark: int, seen_at_mark: DataFrame, updated: str = "time_updated",
               id_column: str = "id") -> DataFrame:
    """Rows at or above the high-water mark, minus the ids already read at the mark itself."""
    newer = rows.filter(F.col(updated) > mark)
    tie = rows.filter(F.col(updated) == mark).join(seen_at_mark.select(id_column), id_column, "left_anti")
    return newer.unionByName(tie.select(rows.columns))


def next_mark(rows: DataFrame, updated: str = "time_updated", id_column: str = "id") -> DataFrame:
    """The new mark and the ids that share it: what the next scan has to remember."""
    newest = rows.agg(F.max(updated))
    return rows.filter(F.col(updated) == newest.scalar()).select(updated, id_column).distinct()


def changed_files(listing: DataFrame, processed: DataFrame) -> DataFrame:
    """Files whose (path, mtime, size) no earlier run has processed."""
    identity = ["path", "modificationTime", "length"]
    return listing.join(processed.select(*identity), identity, "left_anti")
