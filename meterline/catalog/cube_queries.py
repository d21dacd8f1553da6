"""Queries on prices, projects, buckets and the cube."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.catalog.inputs import (COVERED_SQL, NOW_MS, SUMS_SQL, TZ_MIN, hours, local_days, out, priced, query, usage,
                                      with_priced, with_uses)
from meterline.functions import severity, timecols
from meterline.functions.money import limit_weighted_tokens, total_tokens
from meterline.functions.paths import project_label, project_root
from meterline.operators import cube, pricing, projects, rates
from meterline.operators.dedup import keep_first
from meterline.plans import verbs
from meterline.schemas import DIMENSIONS, agents, plan_prices
from meterline.session import scratch_folder, settled

_FROM_DAY, _TO_DAY = 19730, 19740
_DAY = f"CAST(floor((ts_ms + {TZ_MIN} * 60000) / 86400000.0) AS BIGINT)"
_HOUR = "CAST(floor(ts_ms / 3600000.0) AS BIGINT)"
_MINUTE = "CAST(floor(ts_ms / 60000.0) AS BIGINT)"


def day_cells(spark, sf, *keep, since_ms=None, until_ms=None):
    """Cells of the day tier with the dimensions a query asks for, all when it names none."""
    return cube.build_cells(usage(spark, sf, since_ms, until_ms), "day", TZ_MIN, keep=keep or DIMENSIONS)


def hour_cells(spark, sf, *keep, since_ms=None, until_ms=None):
    """Cells of the hour tier with the dimensions a query asks for, all when it names none."""
    return cube.build_cells(usage(spark, sf, since_ms, until_ms), "hour", keep=keep or DIMENSIONS)


def minute_cells(spark, sf, *keep, since_ms=None, until_ms=None):
    """Cells of the minute tier with the dimensions a query asks for, all when it names none."""
    return cube.build_cells(usage(spark, sf, since_ms, until_ms), "minute", keep=keep or DIMENSIONS)


@query("top_projects", with_priced(f"""
SELECT project, CAST(sum(tokens) AS BIGINT) AS tokens, {SUMS_SQL} FROM priced
WHERE {_DAY} BETWEEN {_FROM_DAY} AND {_TO_DAY} GROUP BY project
ORDER BY tokens DESC, cost_usd DESC, project LIMIT 5"""))
def top_projects(spark, sf):
    top = verbs.top(day_cells(spark, sf, "project", **local_days(_FROM_DAY, _TO_DAY)), "project", n=5, from_bucket=_FROM_DAY, to_bucket=_TO_DAY)
    return out(top.drop("covered_cost_usd", "records"))


@query("price_events", with_priced("""
SELECT event_id, CAST(round(cost_usd, 6) AS DOUBLE) AS cost_usd FROM priced"""))
def price_events(spark, sf):
    return out(priced(spark, sf).select("event_id", "cost_usd"))


@query("priced_from_file", with_priced("""
SELECT model, count(*) AS events, CAST(round(coalesce(sum(cost_usd), 0), 6) AS DOUBLE) AS cost_usd FROM priced GROUP BY model"""))
def priced_from_file(spark, sf):
    """A price file written, loaded and applied; its unknown fields and missing rates do no harm."""
    path = scratch_folder(spark, "prices")
    rates = {"input_cost_per_token": "input_rate", "output_cost_per_token": "output_rate",
             "cache_creation_input_token_cost": "creation_rate", "cache_read_input_token_cost": "read_rate"}
    book = pricing.bundled_prices(spark).select("price_key", "position", F.struct(
        *[F.when(F.col(rate) > 0, F.col(rate).cast("double")).alias(name) for name, rate in rates.items()],
        F.lit("chat").alias("mode")).alias("r"))
    # The bundled list has a fixed size, so its file is one.
    book.agg(F.to_json(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("position", "price_key", "r"))), lambda x: F.struct(
        x["price_key"].alias("key"), x["r"].alias("value"))))).alias("value")).coalesce(1).write.text(path)
    rows = pricing.price_rows(usage(spark, sf), pricing.load_prices(spark, f"{path}/*.txt"))
    return out(rows.groupBy("model").agg(F.count("*").alias("events"), F.coalesce(F.sum("cost_usd"), F.lit(0)).alias("cost_usd")))


@query("resolve_models", with_priced("""
SELECT n.model, r.price_key FROM names n LEFT JOIN rates r USING (model)"""))
def resolve_models(spark, sf):
    return pricing.resolve_models(usage(spark, sf), pricing.bundled_prices(spark))


@query("resolve_models_long_list", with_priced("""
SELECT n.model, r.price_key FROM names n LEFT JOIN rates r USING (model)"""))
def resolve_models_long_list(spark, sf):
    return pricing.resolve_models(usage(spark, sf), pricing.bundled_prices(spark), max_literal_keys=0)


@query("unpriced_models", with_priced("""
SELECT n.model FROM names n LEFT JOIN rates r USING (model) WHERE r.model IS NULL"""))
def unpriced_models(spark, sf):
    return pricing.unpriced_models(usage(spark, sf))


@query("normalise_timestamps", with_uses("""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN ts_ms WHEN 1 THEN ts_ms - ts_ms % 1000 END AS parsed_ms FROM uses"""))
def normalise_timestamps(spark, sf):
    """Instants rendered in three ways - with ms, without fraction at +02:00, without a zone - and parsed back."""
    at = F.timestamp_millis("ts_ms")
    shifted = F.timestamp_millis(F.col("ts_ms") + 7_200_000)
    text = (F.when(F.col("event_id") % 3 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
            .when(F.col("event_id") % 3 == 1, F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
            .otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")))
    return usage(spark, sf).select("event_id", timecols.iso_to_ms(text).alias("parsed_ms"))


@query("bucket_events", with_uses(f"""
SELECT event_id, {_MINUTE} AS minute_bucket, {_HOUR} AS hour_bucket, {_DAY} AS day_bucket FROM uses"""))
def bucket_events(spark, sf):
    ts = F.col("ts_ms")
    return usage(spark, sf).select(
        "event_id", timecols.minute_bucket(ts).alias("minute_bucket"),
        timecols.hour_bucket(ts).alias("hour_bucket"), timecols.day_bucket(ts, TZ_MIN).alias("day_bucket"))


@query("local_keys", with_uses("""
SELECT event_id, CAST(floor((ts_ms + 330 * 60000) / 86400000.0) AS BIGINT) AS day_key,
  CAST(floor((ts_ms + 330 * 60000) / 3600000.0) AS BIGINT) AS hour_key,
  CAST(floor((ts_ms + 330 * 60000) / 3600000.0) AS BIGINT) * 3600000 - 330 * 60000 AS hour_start_ms,
  CAST(floor((ts_ms + 330 * 60000) / 86400000.0) AS BIGINT) * 86400000 - 330 * 60000 AS day_start_ms,
  true AS nests FROM uses"""))
def local_keys(spark, sf):
    ts, tz = F.col("ts_ms"), 330
    day, hour = timecols.local_day_key(ts, tz), timecols.local_hour_key(ts, tz)
    return usage(spark, sf).select(
        "event_id", day.alias("day_key"), hour.alias("hour_key"),
        timecols.hour_start_ms(hour, tz).alias("hour_start_ms"), timecols.day_start_ms(day, tz).alias("day_start_ms"),
        (timecols.day_of_hour(hour) == day).alias("nests"))


@query("bucket_bounds", with_uses(f"""
SELECT event_id, {_DAY} * 86400000 - {TZ_MIN} * 60000 AS day_start_ms,
  ({_DAY} + 1) * 86400000 - {TZ_MIN} * 60000 - 1 AS day_end_ms, {_HOUR} * 3600000 AS hour_start_ms,
  ({_HOUR} + 1) * 3600000 - 1 AS hour_end_ms FROM uses"""))
def bucket_bounds(spark, sf):
    day, hour = timecols.day_bucket(F.col("ts_ms"), TZ_MIN), timecols.hour_bucket(F.col("ts_ms"))
    return usage(spark, sf).select(
        "event_id", timecols.bucket_start_ms("day", day, TZ_MIN).alias("day_start_ms"),
        timecols.bucket_end_ms("day", day, TZ_MIN).alias("day_end_ms"),
        timecols.bucket_start_ms("hour", hour).alias("hour_start_ms"),
        timecols.bucket_end_ms("hour", hour).alias("hour_end_ms"))


@query("limit_weighted", with_uses("SELECT event_id, tokens, weighted FROM uses"))
def limit_weighted(spark, sf):
    return usage(spark, sf).select("event_id", total_tokens().alias("tokens"),
                                   limit_weighted_tokens().alias("weighted"))


@query("project_rollup", with_uses("""
SELECT cwd, project, split_part(project, '/', -1) AS label, count(*) AS events FROM uses GROUP BY ALL"""))
def project_rollup(spark, sf):
    distinct = usage(spark, sf).groupBy("cwd").agg(F.count("*").alias("events"))
    return distinct.select("cwd", project_root(F.col("cwd")).alias("project"),
                           project_label(project_root(F.col("cwd"))).alias("label"), "events")


def repo_roots(spark, sf):
    """Every third project folder is a checkout; every fourth is a worktree linked to /w/main<n>."""
    return usage(spark, sf).select("project", (F.col("user_id") % 12).alias("n")).distinct().filter(
        (F.col("n") % 3 == 0) | (F.col("n") % 4 == 1)).select(
        F.col("project").alias("path"),
        F.when(F.col("n") % 4 == 1, F.concat(F.lit("/w/main"), F.col("n").cast("string"),
                                             F.lit("/.git/worktrees/x"))).alias("git_dir"))


@query("project_roots", with_uses("""
SELECT deep AS cwd, CASE WHEN n % 4 = 1 THEN '/w/main' || n WHEN n % 3 = 0 THEN project ELSE deep END AS project,
  count(*) AS events
FROM (SELECT *, user_id % 12 AS n, project || '/src/' || (k % 5) AS deep FROM uses) GROUP BY ALL"""))
def project_roots(spark, sf):
    deep = usage(spark, sf).withColumn("cwd", F.concat("project", F.lit("/src/"), (F.col("k") % 5).cast("string")))
    attributed = projects.attach_roots(deep.drop("project"), repo_roots(spark, sf), home="/w")
    return attributed.groupBy("cwd", "project").agg(F.count("*").alias("events"))


@query("covered_flag", with_uses("""
SELECT agent, agent IN ('claude', 'codex') AS covered, count(*) AS events FROM uses GROUP BY ALL"""))
def covered_flag(spark, sf):
    return usage(spark, sf).groupBy("agent").agg(F.count("*").alias("events")).withColumn(
        "covered", cube.covered_flag(F.col("agent")))


@query("agent_names", with_uses("""
SELECT CASE WHEN id = 255 THEN 'synthetic' WHEN id > 14 THEN 'agent-' || id
  ELSE list_extract(['claude','codex','opencode','pi','gemini','qwen','kimi','goose','kilo','cline','roo','copilot',
  'continue','droid'], CAST(id AS INTEGER)) END AS agent, count(*) AS events
FROM (SELECT CASE WHEN k = 99 THEN 255 ELSE 1 + k % 17 END AS id FROM uses) GROUP BY ALL"""))
def agent_names(spark, sf):
    coded = usage(spark, sf).select(F.when(F.col("k") == 99, 255).otherwise(1 + F.col("k") % 17).cast("int").alias("agent_id"))
    per_id = coded.groupBy("agent_id").agg(F.count("*").alias("events"))
    return cube.agent_named(per_id, agents(spark)).select("agent", "events")


@query("plan_prices", with_uses("""
SELECT agent, plan, CASE agent || '/' || lower(plan) WHEN 'claude/pro' THEN 20.0 WHEN 'claude/max' THEN 100.0
  WHEN 'codex/plus' THEN 20.0 WHEN 'codex/pro' THEN 200.0 WHEN 'codex/free' THEN 0.0 END::DOUBLE AS plan_lo,
  CASE agent || '/' || lower(plan) WHEN 'claude/pro' THEN 20.0 WHEN 'claude/max' THEN 200.0
  WHEN 'codex/plus' THEN 20.0 WHEN 'codex/pro' THEN 200.0 WHEN 'codex/free' THEN 0.0 END::DOUBLE AS plan_hi
FROM (SELECT DISTINCT agent, list_extract(['Pro','MAX','plus','free','team'], CAST(k % 5 + 1 AS INTEGER)) AS plan FROM uses)"""))
def plan_price_lookup(spark, sf):
    plan = F.get(F.array(*[F.lit(p) for p in ("Pro", "MAX", "plus", "free", "team")]), (F.col("k") % 5).cast("int"))
    seen = usage(spark, sf).select("agent", plan.alias("plan")).distinct().withColumn("plan_key", F.lower("plan"))
    known = plan_prices(spark).withColumnRenamed("plan", "plan_key")
    return seen.join(F.broadcast(known), ["agent", "plan_key"], "left").select("agent", "plan", "plan_lo", "plan_hi")


@query("severity_zones", with_uses("""
SELECT event_id, CASE WHEN f >= 0.8 THEN 'red' WHEN f >= 0.5 THEN 'amber' ELSE 'green' END AS window_zone,
  CASE WHEN f >= 0.9 THEN 'red' WHEN f >= 0.7 THEN 'amber' ELSE 'green' END AS load_zone,
  CASE WHEN f >= 0.92 THEN 'red' WHEN f >= 0.8 THEN 'amber' ELSE 'green' END AS disk_zone,
  CASE WHEN f <= 0.15 THEN 'red' WHEN f <= 0.35 THEN 'amber' ELSE 'green' END AS charge_zone
FROM (SELECT event_id, CAST(k AS DOUBLE) / 100 AS f FROM uses)"""))
def severity_zones(spark, sf):
    f = F.col("k").cast("double") / 100
    return usage(spark, sf).select("event_id", *[severity.zone(g, f).alias(f"{g}_zone")
                                                 for g in ("window", "load", "disk", "charge")])


_CUBE_WHERE = "hour_b BETWEEN 473600 AND 473800 AND covered AND model = 'gpt-5.2-codex' AND agent IN ('codex', 'claude')"


@query("cube_filter", with_priced(f"""
SELECT agent, project, {SUMS_SQL} FROM (SELECT *, {_HOUR} AS hour_b FROM priced) WHERE {_CUBE_WHERE} GROUP BY ALL"""))
def cube_filter(spark, sf):
    rows = cube.query(hour_cells(spark, sf, "agent", "model", "project", **hours(473600, 473800)),
                      ["agent", "project"], from_bucket=473600, to_bucket=473800,
                      agents=["codex", "claude", "nobody"], model="gpt-5.2-codex", covered_only=True)
    return out(rows.drop("covered_cost_usd", "records"))


@query("unknown_name_guard", with_priced("""
SELECT 'no project named "/w/nowhere" in this store' AS note, 0::BIGINT AS row_count"""))
def unknown_name_guard(spark, sf):
    rows, note = verbs.history(day_cells(spark, sf, "project"), ["bucket"], project="/w/nowhere")
    return rows.agg(F.lit(note).alias("note"), F.count("*").alias("row_count"))


@query("history_since", with_priced(f"""
SELECT bucket, {SUMS_SQL} FROM (SELECT *, {_DAY} AS bucket FROM priced)
WHERE bucket BETWEEN 19732 AND 19742 GROUP BY bucket"""))
def history_since(spark, sf):
    """Dates on the day tier are the keys themselves: 2024-01-10 to 2024-01-20."""
    span = timecols.resolve_range("day", NOW_MS, "2024-01-10", "2024-01-20", TZ_MIN)
    rows, _ = verbs.history(day_cells(spark, sf, "model", since_ms=span.since_ms, until_ms=span.until_ms), ["bucket"], span=span)
    return out(rows.drop("covered_cost_usd", "records"))


@query("json_rows", with_priced(f"""
SELECT agent, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS events, CAST(round(coalesce(sum(cost_usd), 0), 6) AS DOUBLE) AS cost_usd, 'history' AS verb
FROM (SELECT *, {_DAY} AS bucket FROM priced) WHERE bucket BETWEEN 19732 AND 19742 GROUP BY agent"""))
def json_rows(spark, sf):
    """A result written as JSON rows under a header row, and read back."""
    span = timecols.resolve_range("day", NOW_MS, "2024-01-10", "2024-01-20", TZ_MIN)
    rows, _ = verbs.history(day_cells(spark, sf, "agent", "model", since_ms=span.since_ms, until_ms=span.until_ms), ["agent"], span=span)
    path = scratch_folder(spark, "rows")
    verbs.write_json(rows, "history", span, path)
    lines = spark.read.text(path).select(F.from_json(
        "value", "verb string, agent string, tokens bigint, events bigint, cost_usd double").alias("r")).select("r.*")
    verb = lines.filter(F.col("verb").isNotNull()).select("verb").scalar()
    return lines.filter(F.col("verb").isNull()).select("agent", "tokens", "events", "cost_usd").withColumn("verb", verb)


@query("hot_minutes", with_uses(f"""
SELECT {_MINUTE} AS bucket, CAST(sum(tokens) AS BIGINT) AS tokens FROM uses
WHERE {_MINUTE} * 60000 >= {NOW_MS} - 172800000 GROUP BY 1"""))
def hot_minutes(spark, sf):
    hot = cube.hot_only(minute_cells(spark, sf, "model", since_ms=NOW_MS - timecols.HOT_MAX_AGE_MS), NOW_MS)
    return hot.groupBy("bucket").agg(F.sum(total_tokens()).alias("tokens"))


@query("idle_agents", with_uses(f"""
SELECT agent, max(ts_ms) AS last_event_ms, {NOW_MS} - max(ts_ms) > 300000 AS idle FROM uses
WHERE ts_ms <= {NOW_MS} GROUP BY agent"""))
def idle_agents(spark, sf):
    return rates.idle(usage(spark, sf, until_ms=NOW_MS), NOW_MS, "agent")


@query("cube_by_day_agent_model", with_priced(f"""
SELECT {_DAY} AS bucket, agent, model, {SUMS_SQL}, {COVERED_SQL} FROM priced GROUP BY ALL"""))
def cube_by_day_agent_model(spark, sf):
    return out(cube.query(day_cells(spark, sf, "agent", "model"), ["bucket", "agent", "model"]).drop("records"))


@query("cube_total", with_priced(f"SELECT {SUMS_SQL}, {COVERED_SQL} FROM priced"))
def cube_total(spark, sf):
    return out(cube.query(hour_cells(spark, sf, "agent"), []).drop("records"))


@query("cube_total_of_nothing", with_priced(f"""
SELECT {SUMS_SQL} FROM priced WHERE {_HOUR} < 0 HAVING count(*) > 0"""))
def cube_total_of_nothing(spark, sf):
    return out(cube.query(hour_cells(spark, sf, "agent"), [], from_bucket=0, to_bucket=5).drop("records", "covered_cost_usd"))


@query("hour_series", with_priced(f"SELECT {_HOUR} AS bucket, agent, {SUMS_SQL} FROM priced GROUP BY ALL"))
def hour_series(spark, sf):
    return out(cube.series(hour_cells(spark, sf, "agent"), ["agent"]).drop("records", "covered_cost_usd"))


@query("coarsened_tiers", with_priced(f"""
SELECT 'hour' AS tier, {_HOUR} AS bucket, {SUMS_SQL} FROM priced GROUP BY 2
UNION ALL SELECT 'day', {_DAY}, {SUMS_SQL} FROM priced GROUP BY 2"""))
def coarsened_tiers(spark, sf):
    minute = minute_cells(spark, sf, "agent")
    hour = cube.coarsen(minute, "hour").groupBy("bucket").agg(*cube.sums()).withColumn("tier", F.lit("hour"))
    day = cube.coarsen(minute, "day", TZ_MIN).groupBy("bucket").agg(*cube.sums()).withColumn("tier", F.lit("day"))
    return out(hour.unionByName(day))


@query("compacted_cube", with_priced(f"""
SELECT {_DAY} AS bucket, agent, model, project, session_id, {SUMS_SQL} FROM
(SELECT * FROM priced UNION ALL SELECT * FROM priced WHERE k % 3 = 0) GROUP BY ALL"""))
def compacted_cube(spark, sf):
    """Cells appended twice for a third of the events, then compacted to one row per key."""
    events = usage(spark, sf)
    twice = cube.build_cells(events, "day", TZ_MIN).unionByName(
        cube.build_cells(events.filter(F.col("k") % 3 == 0), "day", TZ_MIN))
    return out(cube.compacted(twice).drop("covered", "delta", "synthetic", "tz_offset_min"))


@query("duplicate_pressure", with_priced(f"""
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS keys,
  round((sum(n) - count(*))::DOUBLE / sum(n), 6) AS duplicate_ratio FROM (
  SELECT count(*) AS n FROM (
    SELECT DISTINCT {_DAY} AS b, agent, model, project, session_id, 1 AS part FROM priced
    UNION ALL SELECT DISTINCT {_DAY} AS b, agent, model, project, session_id, 2 FROM priced WHERE k % 3 = 0)
  GROUP BY b, agent, model, project, session_id)"""))
def duplicate_pressure(spark, sf):
    events = usage(spark, sf)
    twice = cube.build_cells(events, "day", TZ_MIN).unionByName(
        cube.build_cells(events.filter(F.col("k") % 3 == 0), "day", TZ_MIN))
    return out(cube.duplicate_ratio(twice))


def _extent_sql(tier: str, bucket: str, step: int, tz: int, basis: str) -> str:
    return f"""SELECT '{tier}' AS tier, count(*) AS records, min(b) AS first_bucket, max(b) AS last_bucket,
  min(b) * {step} - {tz} * 60000 AS first_ms, max(b) * {step} - {tz} * 60000 AS last_ms,
  {tz}::BIGINT AS tz_offset_min, '{basis}' AS time_basis
  FROM (SELECT DISTINCT {bucket} AS b, agent, model, project, session_id FROM uses)"""


_EXTENTS = " UNION ALL ".join([
    _extent_sql("minute", _MINUTE, 60000, 0, "utc"), _extent_sql("hour", _HOUR, 3600000, 0, "utc"),
    _extent_sql("day", _DAY, 86400000, TZ_MIN, "local")])


# The same of tiers that hold a row per key and third of the events.
_PARTS_EXTENTS = " UNION ALL ".join(
    sql.replace("session_id FROM uses", "session_id, k % 3 FROM uses").replace("AS time_basis", "AS time_basis, true AS has_files, true AS bytes_agree")
    for sql in _EXTENTS.split(" UNION ALL "))


@query("tier_extents", with_uses(_EXTENTS))
def tier_extents(spark, sf):
    return cube.extent({"minute": minute_cells(spark, sf), "hour": hour_cells(spark, sf), "day": day_cells(spark, sf)})


@query("store_summary", with_uses(f"""
SELECT CAST(sum(records) AS BIGINT) AS records, min(first_ms) AS first_ms, max(last_ms) AS last_ms,
  (SELECT count(DISTINCT {_MINUTE}) FROM uses) AS hot_minutes FROM ({_EXTENTS})"""))
def store_summary(spark, sf):
    return cube.store_summary(minute_cells(spark, sf), hour_cells(spark, sf), day_cells(spark, sf))


def _stored(spark, sf) -> str:
    """All tiers of a third of the events after the other, each a batch of one store."""
    folder = scratch_folder(spark, "store")
    for part in range(3):
        minute = settled(cube.build_cells(usage(spark, sf).filter(F.col("k") % 3 == part), "minute"))
        for tier, cells in (("minute", minute), ("hour", cube.coarsen(minute, "hour")), ("day", cube.coarsen(minute, "day", TZ_MIN))):
            cube.append(cells, folder, tier, f"b{part}")
    return folder


@query("compaction_in_place", with_priced(" UNION ALL ".join(f"""
SELECT '{tier}' AS tier, 3 AS batches_before, 1 AS batches_after, count(*) AS rows_after, 0.0::DOUBLE AS duplicate_ratio,
  {SUMS_SQL.replace('count(*)', 'CAST(sum(n) AS BIGINT)')}
FROM (SELECT {bucket} AS b, agent, model, project, session_id, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens,
  sum(cache_creation_tokens) AS cache_creation_tokens, sum(cache_read_tokens) AS cache_read_tokens, count(*) AS n, sum(cost_usd) AS cost_usd
  FROM priced GROUP BY ALL)""" for tier, bucket in (("minute", _MINUTE), ("day", _DAY)))))
def compaction_in_place(spark, sf):
    """Two tiers of three batches are compacted and read again: the same sums from one row per key; then the old folders go."""
    folder, parts = _stored(spark, sf), []
    for tier in ("minute", "day"):
        before = cube.read_tier(spark, folder, tier).select("batch_id").distinct().count()
        assert cube.compact(spark, folder, tier, force=True)
        cube.clear_replaced(spark, folder, tier)
        cells = cube.read_tier(spark, folder, tier)
        ratio = cube.duplicate_ratio(cells).first()
        parts.append(cells.agg(
            F.lit(tier).alias("tier"), F.lit(before).alias("batches_before"), F.countDistinct("batch_id").cast("int").alias("batches_after"),
            F.count(F.lit(1)).alias("rows_after"), F.lit(ratio["duplicate_ratio"]).alias("duplicate_ratio"), *cube.sums()))
    return out(parts[0].unionByName(parts[1]))


def _seen_bytes(spark, folder: str, tier: str) -> DataFrame:
    """What a reader of the rows finds their files to weigh: a second opinion on the listing."""
    files = cube.read_tier(spark, folder, tier).select(
        F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("n")).distinct()
    return files.agg(F.lit(tier).alias("tier"), F.sum("n").alias("seen"))


@query("stored_extents", with_priced(_PARTS_EXTENTS))
def stored_extents(spark, sf):
    """Extents of stored tiers with the bytes of their files, held against the sizes that the reader of the rows sees."""
    folder = _stored(spark, sf)
    seen = reduce(DataFrame.unionByName, [_seen_bytes(spark, folder, t) for t in ("minute", "hour", "day")])
    return cube.stored_extent(spark, folder).join(seen, "tier").select(
        "tier", "records", "first_bucket", "last_bucket", "first_ms", "last_ms", "tz_offset_min", "time_basis",
        (F.col("files") > 0).alias("has_files"), (F.col("bytes") == F.col("seen")).alias("bytes_agree"))


@query("stored_summary", with_priced(f"""
SELECT CAST(sum(records) AS BIGINT) AS records, min(first_ms) AS first_ms, max(last_ms) AS last_ms,
  (SELECT count(DISTINCT {_MINUTE}) FROM uses) AS hot_minutes, true AS bytes_agree FROM ({_PARTS_EXTENTS})"""))
def stored_summary(spark, sf):
    folder = _stored(spark, sf)
    tiers = [cube.read_tier(spark, folder, t) for t in ("minute", "hour", "day")]
    seen = reduce(DataFrame.unionByName, [_seen_bytes(spark, folder, t) for t in ("minute", "hour", "day")]).agg(F.sum("seen")).first()[0]
    return cube.store_summary(*tiers, cube.file_statistics(spark, folder)).withColumn(
        "bytes_agree", F.col("bytes") == seen).drop("bytes")


@query("store_health", with_uses(f"""
SELECT 'day' AS tier, count(*) AS slots, count(*) - count_if(k % 10 = 7) AS valid_records,
  count_if(k % 10 = 7) AS unreadable_slots, min(CASE WHEN k % 10 <> 7 THEN {_DAY} END) AS first_bucket,
  max(CASE WHEN k % 10 <> 7 THEN {_DAY} END) AS last_bucket FROM uses"""))
def store_health(spark, sf):
    """Cells of single events, every tenth with a broken event count."""
    rows = usage(spark, sf).select(
        timecols.day_bucket(F.col("ts_ms"), TZ_MIN).alias("bucket"), "agent", "model", "project", "session_id",
        F.lit(False).alias("delta"), "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens",
        F.when(F.col("k") % 10 == 7, F.lit(-1)).otherwise(F.lit(1)).cast("bigint").alias("events"),
        F.lit(0).cast("decimal(38,12)").alias("cost_usd"))
    return cube.health({"day": rows})


@query("tsv_lines", with_priced(f"""
SELECT agent || chr(9) || project || '\\t' || chr(9) || CAST(count(*) AS VARCHAR) AS value FROM priced GROUP BY agent, project"""))
def tsv_lines(spark, sf):
    """A tab inside a field is written as two characters."""
    rows = usage(spark, sf).groupBy("agent", "project").agg(F.count("*").alias("events"))
    return verbs.tsv_line(rows.withColumn("project", F.concat("project", F.lit("\t"))).select("agent", "project", "events"))


def _coded(spark, sf):
    """Dictionary-coded rows; ids of 120 and above have no name."""
    rows = usage(spark, sf).select("event_id", F.col("user_id").alias("session_code"))
    names = usage(spark, sf).select(F.col("user_id").alias("id"), F.col("session_id").alias("name")).distinct()
    return rows, names.filter((F.col("id") < 120) & (F.col("id") > 0))


@query("named_rows", with_uses("""
SELECT event_id, CASE WHEN user_id = 0 THEN '' WHEN user_id < 120 THEN session_id ELSE '?id:' || user_id END AS session
FROM uses"""))
def named_rows(spark, sf):
    rows, names = _coded(spark, sf)
    return cube.named(rows, names, "session_code", "session").select("event_id", "session")


@query("dangling_references", with_uses("""
SELECT '?id:' || user_id AS reference, count(*) AS rows FROM uses WHERE user_id >= 120 GROUP BY 1"""))
def dangling_references(spark, sf):
    rows, names = _coded(spark, sf)
    return cube.dangling_references(rows, names, "session_code")


@query("export_rows", with_priced(f"""
SELECT {_HOUR} * 3600000 AS bucket_ms, agent, model, project, session_id AS session,
  CAST(sum(input_tokens) AS BIGINT) AS input, CAST(sum(output_tokens) AS BIGINT) AS output,
  CAST(sum(cache_creation_tokens) AS BIGINT) AS cache_creation, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read,
  CAST(CAST(round(coalesce(sum(cost_usd), 0), 6) AS DECIMAL(38,6)) AS VARCHAR) AS cost_usd, count(*) AS events,
  CAST(CAST(round(coalesce(sum(CASE WHEN covered THEN cost_usd END), 0), 6) AS DECIMAL(38,6)) AS VARCHAR) AS covered,
  '0' AS synthetic FROM priced GROUP BY {_HOUR}, agent, model, project, session_id"""))
def export_rows(spark, sf):
    return verbs.export(hour_cells(spark, sf), "hour")


@query("kept_first", with_uses("""
SELECT agent, dedup_key, event_id FROM (
  SELECT agent, 'm' || (event_id % 400) AS dedup_key, event_id,
  row_number() OVER (PARTITION BY agent, event_id % 400 ORDER BY session_id, event_id) AS n FROM uses WHERE k % 7 <> 0)
WHERE n = 1 UNION ALL SELECT agent, NULL, event_id FROM uses WHERE k % 7 = 0"""))
def kept_first(spark, sf):
    events = usage(spark, sf).select(
        "agent", "event_id", F.col("session_id").alias("source_file"), F.lit(0).cast("bigint").alias("line_start"),
        F.col("event_id").alias("line_seq"), F.when(F.col("k") % 7 != 0, F.concat(
            F.lit("m"), (F.col("event_id") % 400).cast("string"))).alias("dedup_key"))
    return keep_first(events).select("agent", "dedup_key", "event_id")
