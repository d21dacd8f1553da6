"""Streams into the cube (ST1-ST4, ST21, ST22, D1 and D2 on a stream).

Two ways to roll up a stream. `windowed_cells` is a watermarked aggregation: one
final row per window, late rows beyond the watermark are dropped - right for rate
windows. `append_cube` adds every micro-batch as additive cells and never drops a
late row, because readers sum repeated keys - right for the stored tiers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterline.functions.money import limit_weighted_tokens
from meterline.functions.timecols import HOT_MAX_AGE_MS
from meterline.operators import cube, dedup, keystore
from meterline.operators.cube import sums
from meterline.operators.projects import with_project
from meterline.schemas import DIMENSIONS, TOKEN_COLUMNS
from meterline.session import settled


def with_event_time(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", late)


def windowed_cells(events: DataFrame, width: str = "1 minute", late: str = "48 hours") -> DataFrame:
    """Tokens and events per window and dimension, emitted once the watermark has passed."""
    timed = with_event_time(events, late)
    return timed.groupBy(F.window("event_time", width).alias("w"), *DIMENSIONS).agg(
        *sums(TOKEN_COLUMNS), F.count("*").alias("events")).select(
        F.unix_millis("w.start").alias("window_start_ms"), *DIMENSIONS, *TOKEN_COLUMNS, "events")


def rate_windows(events: DataFrame, width: str = "10 seconds", late: str = "20 minutes") -> DataFrame:
    """Limit-weighted tokens per trace period; rows older than the window are dropped, as the ring does."""
    timed = with_event_time(events, late)
    return timed.groupBy(F.window("event_time", width).alias("w")).agg(
        F.sum(limit_weighted_tokens()).alias("tokens")).select(
        F.unix_millis("w.start").alias("window_start_ms"), "tokens")


def gauge_windows(samples: DataFrame, metrics: list[str], width: str = "5 seconds", late: str = "30 minutes") -> DataFrame:
    """Last value per period of the enabled metrics; a masked metric leaves a gap."""
    timed = with_event_time(samples.filter(F.col("metric").isin(metrics)), late)
    return timed.groupBy(F.window("event_time", width).alias("w"), "host", "metric").agg(
        F.max_by("value", "ts_ms").alias("value")).select(
        F.unix_millis("w.start").alias("window_start_ms"), "host", "metric", "value")


def dedup_keyed(events: DataFrame) -> DataFrame:
    """Keyed events once, however late they come. Unkeyed events get a key of their own.

    No watermark, so no row is dropped for its age and the keys stay: run it on a state
    store that keeps them on disk (`disk_state`).
    """
    own = F.coalesce("dedup_key", F.concat_ws("#", "source_file", F.col("line_start").cast("string"),
                                              F.col("line_seq").cast("string")))
    return events.withColumn("seen_key", own).dropDuplicates(["agent", "seen_key"]).drop("seen_key")


@contextmanager
def disk_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; a query keeps the setting that it was started with."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return like.limit(0).withColumn("batch_id", F.lit(""))


def append_cube(events: DataFrame, path: str, checkpoint: str, tz_offset_min: int = 0,
                prices: DataFrame | None = None, now_ms: Callable[[], int] | None = None,
                keyed: bool = False, trigger: dict | None = None,
                parse: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Write all three tiers from a stream of usage events.

    With `parse` the stream is log lines, which a source job turns into events batch
    by batch; a file lands whole in one batch, so its headers and counters do too.

    Every batch is aggregated first and appended under its own batch id, which a
    replayed batch overwrites, so a retry does not count twice. With `keyed` the
    events are matched against all keys ever stored, without a horizon; only the stored buckets that may hold one are read.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        tag = f"b{batch_id:012d}"
        if parse:
            ordered = batch.withColumn("line_seq", F.monotonically_increasing_id())
            batch = with_project(parse(ordered))
        if keyed:
            first = dedup.keep_first(batch).persist()
            keys = keystore.matching(spark, f"{path}/keys", first, batch_id)
            batch = dedup.not_yet_stored(first, keys).persist()
        # The batch is read once; all tiers sum its minute cells, late rows included.
        minute = cube.build_cells(batch, "minute", 0, prices).persist()
        try:
            cube.append(cube.hot_only(minute, now_ms()) if now_ms else minute, path, "minute", tag)
            cube.append(cube.coarsen(minute, "hour"), path, "hour", tag)
            cube.append(cube.coarsen(minute, "day", tz_offset_min), path, "day", tag)
            if keyed:
                # Keys go last: a batch that fails before is replayed with its events still new.
                keystore.add(batch, f"{path}/keys", batch_id)
        finally:
            minute.unpersist()
            if keyed:
                batch.unpersist()
                first.unpersist()

    return (events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def prune_hot(spark: SparkSession, path: str, now_ms: int) -> DataFrame:
    """The minute tier without cells older than 48 hours; whole day partitions are pruned at the scan."""
    first_day = (now_ms - HOT_MAX_AGE_MS) // 86_400_000
    return cube.hot_only(cube.read_tier(spark, path, "minute").filter(F.col("part_day") >= first_day), now_ms)


def backfill_once(spark: SparkSession, events: DataFrame, path: str, generation: str, tz_offset_min: int = 0,
                  prices: DataFrame | None = None, now_ms: int | None = None) -> bool:
    """Replay a whole history into the cube exactly once per store generation.

    With `now_ms` the minute tier takes the last 48 hours only, as the stream does.

    The marker row is written last and the cells under a fixed batch id, so a
    broken run is repeated and overwrites what it had written.
    """
    control = f"{path}/backfills"
    done = _stored(spark, control, spark.range(1).select(F.lit("").alias("generation")))
    if not done.filter(F.col("generation") == generation).isEmpty():
        return False
    tag = f"backfill-{generation}"
    # Minute cells are the one read of the events; the other tiers sum them, and only young ones are kept.
    minute = settled(cube.build_cells(events, "minute", 0, prices))
    cube.append(cube.hot_only(minute, now_ms) if now_ms is not None else minute, path, "minute", tag)
    cube.append(cube.coarsen(minute, "hour"), path, "hour", tag)
    cube.append(cube.coarsen(minute, "day", tz_offset_min), path, "day", tag)
    spark.range(1).select(F.lit(generation).alias("generation"), F.lit(generation).alias("batch_id")).write.mode(
        "append").parquet(control)
    return True
