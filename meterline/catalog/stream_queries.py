"""Streaming queries, run to the end of the events table and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.catalog.cube_queries import _DAY, _HOUR, _MINUTE
from meterline.catalog.inputs import NOW_MS, SUMS_SQL, TZ_MIN, out, query, usage, usage_from, with_priced, with_uses
from meterline.catalog.signal_queries import DELIVERED_SQL, _PACED, host_walls, newest, readings_from
from meterline.functions.money import total_tokens
from meterline.operators import cube
from meterline.session import scratch_folder as scratch
from meterline.session import settled
from meterline.streaming import cube_stream, state_stream


def events_stream(spark, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def usage_stream(spark, sf_dir: str) -> DataFrame:
    return usage_from(events_stream(spark, sf_dir))


def usage_in_batches(spark, sf_dir: str, batches: int = 3, files: int = 4, late: Column | None = None, closing_hours: int = 0) -> DataFrame:
    """The same events landed in order, so that state has to be carried from one micro-batch to the next.

    Rows that are `late` land in a batch of their own after the others. With `closing_hours` a last batch
    has a few events that much later than all others, so that windows before them close.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = scratch(spark, "landed")
    first, last, newest = events.agg(F.min("event_id"), F.max("event_id"), F.max("ts")).first()
    if first is None:
        return usage_stream(spark, sf_dir)
    step = -(-(last - first + 1) // batches)
    on_time = events if late is None else events.where(~late)
    parts = [on_time.where(F.col("event_id").between(first + k * step, first + (k + 1) * step - 1)) for k in range(batches)]
    if late is not None:
        parts.append(events.where(late))
    if closing_hours:
        parts.append(events.limit(files).withColumn("ts", F.lit(newest) + F.expr(f"INTERVAL {closing_hours} HOURS")))
    for part in parts:
        part.repartition(files).write.mode("append").parquet(folder)
    return usage_from(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(folder))


def drained(stream: DataFrame, name: str) -> DataFrame:
    """All rows a stream emits up to the end of its input, through a parquet sink."""
    spark = stream.sparkSession
    folder = scratch(spark, name)
    (stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
     .trigger(availableNow=True).start(f"{folder}/rows").awaitTermination())
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def drained_updates(stream: DataFrame, name: str) -> DataFrame:
    """The same of a stream in output mode "update": all updates, a folder per micro-batch that a replay overwrites."""
    spark = stream.sparkSession
    folder = scratch(spark, name)
    (stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint")
     .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}"))
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows").select(stream.columns)


@query("streamed_cube", with_priced(f"""
SELECT 'minute' AS tier, {_MINUTE} AS bucket, agent, {SUMS_SQL} FROM priced GROUP BY ALL
UNION ALL SELECT 'hour', {_HOUR}, agent, {SUMS_SQL} FROM priced GROUP BY ALL
UNION ALL SELECT 'day', {_DAY}, agent, {SUMS_SQL} FROM priced GROUP BY ALL"""))
def streamed_cube(spark, sf):
    """All tiers written by a stream, every batch an append, and summed on reading."""
    folder = scratch(spark, "streamed-cube")
    cube_stream.append_cube(usage_stream(spark, sf), f"{folder}/cube", f"{folder}/checkpoint", TZ_MIN).awaitTermination()
    parts = [cube.query(cube.read_tier(spark, f"{folder}/cube", tier), ["bucket", "agent"]).withColumn("tier", F.lit(tier))
             for tier in ("minute", "hour", "day")]
    return out(parts[0].unionByName(parts[1]).unionByName(parts[2]).drop("covered_cost_usd", "records"))


@query("backfilled_cube", with_priced(f"SELECT {_DAY} AS bucket, {SUMS_SQL} FROM priced GROUP BY ALL"))
def backfilled_cube(spark, sf):
    """The whole history replayed into a new store twice under one generation: the second run does nothing."""
    folder = scratch(spark, "backfill")
    for _ in range(2):
        cube_stream.backfill_once(spark, usage(spark, sf), folder, "g1", TZ_MIN)
    return out(cube.query(cube.read_tier(spark, folder, "day"), ["bucket"]).drop("covered_cost_usd", "records"))


@query("streamed_windows", with_uses("""
SELECT ts_ms // 3600000 * 3600000 AS window_start_ms, agent, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS events
FROM uses GROUP BY ALL"""))
def streamed_windows(spark, sf):
    """Hourly windows in append mode: later events move the watermark past all windows of the table."""
    counted = cube_stream.with_event_time(usage_in_batches(spark, sf, 1, closing_hours=50), "48 hours").groupBy(
        F.window("event_time", "1 hour").alias("w"), "agent").agg(
        F.sum(total_tokens()).alias("tokens"), F.count("*").alias("events")).select(
        F.unix_millis("w.start").alias("window_start_ms"), "agent", "tokens", "events")
    return drained(counted, "streamed-windows")


# Rows of every eleventh k land after all others, and closing rows ten hours later last. When a batch starts, the watermark is two hours behind
# the newest event of the batches before it; windows that end there come out of that batch, and rows are late by the
# watermark that the batch before it started with. So a row between the two comes out by itself.
_LATE = "k % 11 = 3"
_LANDED = f"""
, edges AS (SELECT min(event_id) AS f, max(event_id) AS l FROM uses),
landed AS (SELECT u.*, CASE WHEN {_LATE} THEN 3 ELSE (event_id - f) // ((l - f + 3) // 3) END AS batch, (ts_ms // 3600000 + 1) * 3600000 AS ends FROM uses u, edges),
marks AS (SELECT m, CASE WHEN m = 5 THEN (SELECT max(ts_ms) FROM uses) + 28800000 ELSE (SELECT max(ts_ms) - 7200000 FROM landed WHERE batch < m) END AS mark
  FROM range(0, 6) t(m)),
kept AS (SELECT l.* FROM landed l LEFT JOIN marks k ON k.m = l.batch - 1 WHERE coalesce(l.ends > k.mark, true)),
emitted AS (SELECT k.*, (SELECT min(m) FROM marks WHERE m >= k.batch AND mark >= k.ends) AS out FROM kept k)
"""


def _late() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint") % 11 == 3


@query("late_windows", with_uses(_LANDED + """
SELECT ts_ms // 3600000 * 3600000 AS window_start_ms, agent, model, project, session_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens, count(*) AS events FROM emitted GROUP BY 1, 2, 3, 4, 5, out"""))
def late_windows(spark, sf):
    """Watermarked cells of three batches and a late one: rows behind the watermark are dropped, every window comes out as it closes."""
    stream = usage_in_batches(spark, sf, late=_late(), closing_hours=10)
    cells = drained(cube_stream.windowed_cells(stream, "1 hour", "2 hours"), "late-windows")
    return cells.select("window_start_ms", "agent", "model", "project", "session_id", "input_tokens", "output_tokens", "events")


@query("late_cube", with_priced(f"""
SELECT 'minute' AS tier, agent, count(DISTINCT {_MINUTE}) AS buckets, {SUMS_SQL} FROM priced GROUP BY ALL
UNION ALL SELECT 'hour', agent, count(DISTINCT {_HOUR}), {SUMS_SQL} FROM priced GROUP BY ALL
UNION ALL SELECT 'day', agent, count(DISTINCT {_DAY}), {SUMS_SQL} FROM priced GROUP BY ALL"""))
def late_cube(spark, sf):
    """The same batches into the stored tiers: a late row lands in all of them, however old its bucket is."""
    folder = scratch(spark, "late-cube")
    cube_stream.append_cube(usage_in_batches(spark, sf, late=_late()), f"{folder}/cube", f"{folder}/checkpoint", TZ_MIN).awaitTermination()
    parts = [cube.read_tier(spark, f"{folder}/cube", tier).groupBy("agent").agg(
        F.countDistinct("bucket").alias("buckets"), *cube.sums()).withColumn("tier", F.lit(tier)) for tier in ("minute", "hour", "day")]
    return out(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("hot_backfill", with_priced(f"""
SELECT 'minute' AS tier, {SUMS_SQL} FROM priced WHERE {_MINUTE} * 60000 >= {NOW_MS} - 172800000
UNION ALL SELECT 'hour', {SUMS_SQL} FROM priced UNION ALL SELECT 'day', {SUMS_SQL} FROM priced"""))
def hot_backfill(spark, sf):
    """A backfill behind the gate of the hot tier: minutes of the last 48 hours, hours and days of the whole history."""
    folder = scratch(spark, "hot-backfill")
    cube_stream.backfill_once(spark, usage(spark, sf), folder, "g1", TZ_MIN, now_ms=NOW_MS)
    parts = [cube.read_tier(spark, folder, tier).agg(F.lit(tier).alias("tier"), *cube.sums()) for tier in ("minute", "hour", "day")]
    return out(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("streamed_rates", with_uses("""
, edges AS (SELECT min(event_id) AS f, max(event_id) AS l FROM uses),
landed AS (SELECT ts_ms, weighted, (event_id - f) // ((l - f + 3) // 3) AS batch FROM uses, edges),
marks AS (SELECT batch, max(max(ts_ms)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1200000 AS mark
  FROM landed GROUP BY batch)
SELECT ts_ms // 10000 * 10000 AS window_start_ms, CAST(sum(weighted) AS BIGINT) AS tokens FROM landed JOIN marks USING (batch)
WHERE coalesce((ts_ms // 10000 + 1) * 10000 > mark, true) GROUP BY 1
HAVING window_start_ms + 10000 <= (SELECT max(ts_ms) - 1200000 FROM uses)"""))
def streamed_rates(spark, sf):
    """Rate windows over three micro-batches: rows behind the watermark are dropped, open windows are not yet out."""
    rates = cube_stream.rate_windows(usage_in_batches(spark, sf))
    return drained(rates, "streamed-rates").select("window_start_ms", F.col("tokens").cast("bigint"))


@query("streamed_dedup", with_uses("""
SELECT agent, count(*) AS events, count(DISTINCT event_id) AS distinct_events FROM uses GROUP BY agent"""))
def streamed_dedup(spark, sf):
    """Every third row arrives twice under one key; rows of k divisible by 7 carry none and count once each."""
    u = usage_stream(spark, sf)
    copies = u.withColumn("copy", F.explode(F.when((F.col("k") % 3 == 0) & (F.col("k") % 7 != 0), F.array(
        F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    keyed = copies.select("agent", "ts_ms", "event_id", F.lit("f").alias("source_file"),
                          F.col("copy").cast("bigint").alias("line_start"), F.col("event_id").alias("line_seq"),
                          F.when(F.col("k") % 7 != 0, F.col("event_id").cast("string")).alias("dedup_key"))
    with cube_stream.disk_state(spark):
        kept = drained(cube_stream.dedup_keyed(keyed).select("agent", "event_id"), "streamed-dedup")
    return kept.groupBy("agent").agg(F.count("*").alias("events"), F.countDistinct("event_id").alias("distinct_events"))


def readings_stream(spark, sf) -> DataFrame:
    return readings_from(usage_stream(spark, sf))


@query("streamed_pace", "WITH RECURSIVE " + with_uses(
    _PACED.replace("PARTITION BY host, agent, kind", "PARTITION BY agent, kind").replace("n.host = q.host AND ", "") + """
SELECT agent, kind, seq, round(v, 6) AS pace FROM paced""").removeprefix("WITH "))
def streamed_pace(spark, sf):
    paced = drained(state_stream.pace_stream(readings_stream(spark, sf)), "streamed-pace")
    return out(paced.select("agent", "kind", "seq", "pace"))


@query("stored_pace", "WITH RECURSIVE " + with_uses(
    _PACED.replace("PARTITION BY host, agent, kind", "PARTITION BY agent, kind").replace("n.host = q.host AND ", "") + """
SELECT agent, kind, seq, round(v, 6) AS pace FROM paced""").removeprefix("WITH "))
def stored_pace(spark, sf):
    """The same over three micro-batches, each folded in chunks from the states that the one before it stored."""
    folder = scratch(spark, "stored-pace")
    state_stream.stored_pace(readings_from(usage_in_batches(spark, sf)), ["agent", "kind"], folder, f"{folder}/checkpoint").awaitTermination()
    return out(spark.read.schema("agent string, kind string, seq bigint, read_at_ms bigint, used_percent double, pace double").parquet(
        f"{folder}/rows").select("agent", "kind", "seq", "pace"))


@query("streamed_sessions", with_uses("""
, s AS (SELECT agent, session_id, coalesce(max(ts_ms) FILTER (k % 5 <> 0), 0) AS last_event_ms,
  coalesce(max(ts_ms) FILTER (k % 5 = 0), 0) AS last_growth_ms, arg_max(k % 5 = 0, event_id) AS mid_turn FROM uses GROUP BY ALL),
newest AS (SELECT max(ts_ms) AS now_ms FROM uses)
SELECT agent, session_id, last_event_ms, last_growth_ms, mid_turn, CASE
  WHEN now_ms - greatest(last_event_ms, last_growth_ms) > 1800000 THEN 'done'
  WHEN now_ms - greatest(last_event_ms, last_growth_ms) <= 120000 OR (mid_turn AND now_ms - last_growth_ms <= 600000) THEN 'running'
  ELSE 'idle' END AS state FROM s, newest"""))
def streamed_sessions(spark, sf):
    """Three micro-batches; the last update of a session is the one with its last signal."""
    signals = usage_in_batches(spark, sf).select(
        "agent", "session_id", F.when(F.col("k") % 5 == 0, "growth").otherwise("event").alias("kind"),
        F.col("ts_ms").alias("at_ms"), F.col("event_id").alias("seq"))
    updates = drained_updates(state_stream.session_stream(signals, now_ms=newest(spark, sf), mode="update"), "streamed-sessions")
    last = updates.groupBy("agent", "session_id").agg(F.max_by(
        F.struct("last_event_ms", "last_growth_ms", "mid_turn", "state"), "seq").alias("s"))
    return last.select("agent", "session_id", "s.*")


def _observed(spark, sf) -> DataFrame:
    """Readings in three micro-batches, walls joined in from the readings so far: these are computed once, not by every batch."""
    walls = settled(host_walls(spark, sf).select(
        "host", "seq", F.col("agent").alias("wall_agent"), F.col("kind").alias("wall_kind"),
        F.col("used_percent").alias("wall_percent"), "wall_at_ms"))
    return readings_from(usage_in_batches(spark, sf)).join(walls, ["host", "seq"], "left")


@query("streamed_alerts", DELIVERED_SQL.replace("{more}", ""))
def streamed_alerts(spark, sf):
    """Alerts from the stateful stream."""
    return out(drained(state_stream.alert_stream(_observed(spark, sf)), "streamed-alerts").drop("now_ms"))


@query("stored_alerts", DELIVERED_SQL.replace("{more}", ""))
def stored_alerts(spark, sf):
    """The same with the state of the hosts in tables, every micro-batch folded in chunks."""
    folder = scratch(spark, "stored-alerts")
    state_stream.stored_alerts(_observed(spark, sf), folder, f"{folder}/checkpoint").awaitTermination()
    rows = spark.read.schema("host bigint, seq bigint, agent string, kind string, alert string, threshold int, percent double, prev_high double")
    return out(rows.parquet(f"{folder}/rows").select("host", "seq", "agent", "kind", "alert", "threshold", "percent", "prev_high"))

