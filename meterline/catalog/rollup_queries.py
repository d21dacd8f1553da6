"""Queries on rollups, rankings, sessions and scopes."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from meterline.catalog.cube_queries import _DAY, _HOUR, day_cells
from meterline.catalog.inputs import (COVERED_SQL, NOW_MS, SUMS_SQL, TZ_MIN, hours, local_days, out, query, usage,
                                      with_priced)
from meterline.functions.money import total_tokens
from meterline.operators import projects, ranking, rollups
from meterline.plans import report, verbs
from meterline.schemas import agents, plan_prices

_LHOUR = f"CAST(floor((ts_ms + {TZ_MIN} * 60000) / 3600000.0) AS BIGINT)"
_TODAY = (NOW_MS + TZ_MIN * 60_000) // 86_400_000
_THIS_HOUR = (NOW_MS + TZ_MIN * 60_000) // 3_600_000
_ZEROED = """CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens,
  CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens,
  CAST(coalesce(sum(cache_creation_tokens), 0) AS BIGINT) AS cache_creation_tokens,
  CAST(coalesce(sum(cache_read_tokens), 0) AS BIGINT) AS cache_read_tokens, CAST(count(event_id) AS BIGINT) AS events,
  CAST(round(coalesce(sum(cost_usd), 0), 6) AS DOUBLE) AS cost_usd"""


def cells(spark, sf, *keep, since_ms=None, until_ms=None):
    """Hourly cells with the dimensions a rollup asks for beside hour, agent and model."""
    return rollups.hourly_cells(usage(spark, sf, since_ms, until_ms), TZ_MIN, keep=keep)


def days_back(spark, sf, days: int):
    """Cells of the last local days, today included."""
    return cells(spark, sf, **local_days(_TODAY - days + 1, _TODAY))


def this_month(spark, sf):
    """Cells of the local month of now."""
    first = date.fromordinal(date(1970, 1, 1).toordinal() + _TODAY).replace(day=1)
    following = (first + timedelta(days=31)).replace(day=1)
    return cells(spark, sf, **local_days(*((d - date(1970, 1, 1)).days - late for d, late in ((first, 0), (following, 1)))))


@query("rollup_dimensions", with_priced(f"""
, keyed AS (SELECT *, {_DAY} AS day_key, {_LHOUR} AS hour_key FROM priced)
SELECT * FROM (
SELECT CASE WHEN grouping(hour_key) = 0 THEN 'hour_agent' WHEN grouping(agent) = 0 THEN 'agent'
  WHEN grouping(day_key) = 0 THEN 'day' WHEN grouping(session_id) = 0 THEN 'session'
  WHEN grouping(model) = 0 THEN 'model' WHEN grouping(project) = 0 THEN 'project' ELSE 'all' END AS dimension,
  CASE WHEN grouping(hour_key) = 0 THEN hour_key || '/' || agent WHEN grouping(agent) = 0 THEN agent
  WHEN grouping(day_key) = 0 THEN CAST(day_key AS VARCHAR) WHEN grouping(session_id) = 0 THEN session_id
  WHEN grouping(model) = 0 THEN model WHEN grouping(project) = 0 THEN project ELSE 'all' END AS member,
  {SUMS_SQL}, {COVERED_SQL} FROM keyed
GROUP BY GROUPING SETS ((), (agent), (day_key), (hour_key, agent), (session_id), (model), (project)))
WHERE member <> ''"""))
def rollup_dimensions(spark, sf):
    return out(rollups.rollup(cells(spark, sf, "project", "session_id")))


@query("today_totals", with_priced(f"SELECT {SUMS_SQL} FROM priced WHERE {_DAY} = {_TODAY}"))
def today_totals(spark, sf):
    return out(rollups.today(days_back(spark, sf, 1), NOW_MS, TZ_MIN))


@query("this_hour_totals", with_priced(f"SELECT {SUMS_SQL} FROM priced WHERE {_LHOUR} = {_THIS_HOUR}"))
def this_hour_totals(spark, sf):
    return out(rollups.this_hour(cells(spark, sf, **hours(_THIS_HOUR, _THIS_HOUR, TZ_MIN)), NOW_MS, TZ_MIN))


_FROM_MS, _TO_MS = NOW_MS - 7 * 86_400_000, NOW_MS
# Whole hours around the range: the rollup decides by hour.
_RANGE_HOURS = hours(_FROM_MS // 3_600_000 - 1, _TO_MS // 3_600_000 + 1)
_IN_RANGE = f"{_LHOUR} * 3600000 - {TZ_MIN} * 60000 >= {_FROM_MS} AND {_LHOUR} * 3600000 - {TZ_MIN} * 60000 < {_TO_MS}"


@query("range_totals", with_priced(f"SELECT {SUMS_SQL} FROM priced WHERE {_IN_RANGE}"))
def range_totals(spark, sf):
    return out(rollups.in_range(cells(spark, sf, **_RANGE_HOURS), _FROM_MS, _TO_MS, TZ_MIN))


@query("range_totals_by_agent", with_priced(f"SELECT agent, {SUMS_SQL} FROM priced WHERE {_IN_RANGE} GROUP BY agent"))
def range_totals_by_agent(spark, sf):
    return out(rollups.in_range(cells(spark, sf, **_RANGE_HOURS), _FROM_MS, _TO_MS, TZ_MIN, by_agent=True))


_MONTH = f"date_trunc('month', DATE '1970-01-01' + CAST({_DAY} AS INTEGER)) = DATE '2024-01-01'"


@query("month_rollup", with_priced(f"""
SELECT {SUMS_SQL}, {COVERED_SQL}, count(DISTINCT {_DAY}) AS active_days, 19723::BIGINT AS first_day_key,
  31::BIGINT AS day_count FROM priced WHERE {_MONTH}"""))
def month_rollup(spark, sf):
    return out(rollups.month_rollup(this_month(spark, sf), NOW_MS, TZ_MIN))


@query("month_rollup_by_agent", with_priced(f"""
SELECT agent, {SUMS_SQL}, {COVERED_SQL}, count(DISTINCT {_DAY}) AS active_days, 19723::BIGINT AS first_day_key,
  31::BIGINT AS day_count FROM priced WHERE {_MONTH} GROUP BY agent"""))
def month_rollup_by_agent(spark, sf):
    return out(rollups.month_rollup(this_month(spark, sf), NOW_MS, TZ_MIN, by_agent=True))


@query("covered_cost_in_days", with_priced(f"""
SELECT CAST(round(coalesce(sum(cost_usd), 0), 6) AS DOUBLE) AS covered_cost_usd FROM priced
WHERE covered AND {_DAY} BETWEEN 19730 AND 19739"""))
def covered_cost_in_days(spark, sf):
    return out(rollups.covered_cost(cells(spark, sf, **local_days(19730, 19739)), 19730, 10))


_SPANS = f"""
, by_row AS (SELECT session_id, agent, project, {_DAY} AS b, sum(tokens) AS t, min(event_id) AS e FROM priced GROUP BY ALL),
spans AS (SELECT session_id, agent, {SUMS_SQL}, CAST(sum(tokens) AS BIGINT) AS tokens,
  min({_DAY}) * 86400000 - {TZ_MIN} * 60000 AS first_ms, max({_DAY}) * 86400000 - {TZ_MIN} * 60000 AS last_ms
  FROM priced GROUP BY ALL),
best AS (SELECT session_id, agent, project FROM by_row QUALIFY row_number() OVER (PARTITION BY session_id, agent
  ORDER BY t DESC, b, project) = 1)
"""


def _two_project_usage(spark, sf):
    """Sessions that move between two projects, so that the heaviest row decides."""
    return usage(spark, sf).withColumn("project", F.concat("project", F.when(F.col("k") % 2 == 0, "a").otherwise("b")))


@query("session_spans", with_priced(_SPANS.replace("FROM priced", "FROM moved").replace(
    ", by_row", ", moved AS (SELECT * REPLACE (project || CASE WHEN k % 2 = 0 THEN 'a' ELSE 'b' END AS project) FROM priced), by_row") + """
SELECT s.* EXCLUDE (tokens), b.project FROM spans s JOIN best b USING (session_id, agent)"""))
def session_spans(spark, sf):
    from meterline.operators.cube import build_cells
    return out(rollups.session_spans(build_cells(_two_project_usage(spark, sf), "day", TZ_MIN), "day", TZ_MIN))


@query("newest_sessions", with_priced(_SPANS + """
SELECT s.*, b.project FROM spans s JOIN best b USING (session_id, agent)
ORDER BY last_ms DESC, tokens DESC, session_id, agent LIMIT 20"""))
def newest_sessions(spark, sf):
    return out(verbs.sessions(day_cells(spark, sf, "agent", "session_id", "project"), "day", TZ_MIN, n=20))


@query("session_rollup", with_priced(f"""
SELECT session_id, {SUMS_SQL}, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, arg_min(agent, event_id) AS agent
FROM priced GROUP BY session_id"""))
def session_rollup(spark, sf):
    return out(rollups.sessions(usage(spark, sf)))


@query("merged_projects", with_priced(f"""
SELECT CASE WHEN user_id % 12 < 6 THEN '/w/left' ELSE project END AS project, {SUMS_SQL} FROM priced GROUP BY 1"""))
def merged_projects(spark, sf):
    totals = rollups.totals(cells(spark, sf, "project"), "project")
    mapping = usage(spark, sf).filter(F.col("user_id") % 12 < 6).select("project").distinct().withColumn(
        "new_project", F.lit("/w/left"))
    return out(projects.merge_projects(totals, mapping))


_TRIP = NOW_MS - 36 * 3_600_000


@query("trip_meter", with_priced(f"""
SELECT {_ZEROED}, round(CAST(coalesce(sum(cost_usd), 0) AS DOUBLE) * 3600000 / {36 * 3_600_000}, 6) AS cost_per_hour
FROM priced WHERE ts_ms >= {_TRIP} AND ts_ms <= {NOW_MS}"""))
def trip_meter(spark, sf):
    return out(rollups.trip(usage(spark, sf, _TRIP, NOW_MS), _TRIP, NOW_MS))


@query("subscription_value", with_priced(f"""
SELECT 300.0::DOUBLE AS plan_lo_usd, 400.0::DOUBLE AS plan_hi_usd, false AS incomplete,
  CAST(round(sum(cost_usd), 6) AS DOUBLE) AS covered_month_cost_usd,
  round(CAST(sum(cost_usd) AS DOUBLE) / 400.0, 6) AS multiple FROM priced WHERE covered AND {_MONTH}"""))
def subscription_value(spark, sf):
    usage_cells = cells(spark, sf)
    plans = usage(spark, sf).select("agent").distinct().filter(F.col("agent").isin("claude", "codex")).withColumn(
        "plan", F.when(F.col("agent") == "claude", "MAX").otherwise("pro"))
    return out(rollups.subscription_value(
        rollups.month_rollup(usage_cells, NOW_MS, TZ_MIN, by_agent=True), rollups.totals(usage_cells, "agent"),
        plans, plan_prices(spark)))


@query("others_row", with_priced(f"""
SELECT CASE WHEN covered THEN agent ELSE 'others' END AS agent_group, {SUMS_SQL},
  count(DISTINCT agent) AS active_agents FROM priced GROUP BY 1"""))
def others_row(spark, sf):
    return out(rollups.others(cells(spark, sf)))


@query("agent_rank", with_priced(f"""
SELECT agent, {SUMS_SQL}, CASE agent WHEN 'claude' THEN 1 WHEN 'codex' THEN 2 WHEN 'opencode' THEN 3
  WHEN 'gemini' THEN 5 WHEN 'goose' THEN 8 END::BIGINT AS agent_order FROM priced GROUP BY agent"""))
def agent_rank(spark, sf):
    return out(rollups.agent_rank(cells(spark, sf)).orderBy(F.desc("cost_usd"), "agent_order"))


@query("cost_share", with_priced("""
, ranked AS (SELECT agent, sum(cost_usd) AS c, row_number() OVER (ORDER BY sum(cost_usd) DESC) AS place
  FROM priced GROUP BY agent)
SELECT CASE WHEN place <= 3 THEN agent ELSE 'other' END AS segment, CAST(round(sum(c), 6) AS DOUBLE) AS cost_usd,
  min(place) AS place, round(CAST(sum(c) AS DOUBLE) / (SELECT CAST(sum(c) AS DOUBLE) FROM ranked), 6) AS share
FROM ranked GROUP BY 1"""))
def cost_share(spark, sf):
    return out(rollups.cost_share(cells(spark, sf), top=3))


def _trailing_sql(bucket: str, newest: int, length: int) -> str:
    return f"""
SELECT b AS bucket_key, {_ZEROED}, b = {newest} AS partial
FROM (SELECT unnest(range({newest - length + 1}, {newest + 1})) AS b) LEFT JOIN priced ON {bucket} = b GROUP BY b"""


@query("trailing_days", with_priced(_trailing_sql(_DAY, _TODAY, 40).replace("bucket_key", "day_key")))
def trailing_days(spark, sf):
    """Forty days, so the first twenty lie before the data and read zero."""
    return out(rollups.trailing(days_back(spark, sf, 40), "day", NOW_MS, 40, TZ_MIN))


@query("trailing_hours", with_priced(_trailing_sql(_LHOUR, _THIS_HOUR, 48).replace("bucket_key", "hour_key")))
def trailing_hours(spark, sf):
    return out(rollups.trailing(cells(spark, sf, **hours(_THIS_HOUR - 47, _THIS_HOUR, TZ_MIN)), "hour", NOW_MS, 48, TZ_MIN))


def _scope_sql(bucket: str, newest: int, length: int, label: str) -> str:
    return f"""
SELECT b AS bucket, {label} AS label, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, count(event_id) AS events,
  CASE WHEN b = {newest} THEN 0.0 ELSE CAST(round(coalesce(sum(cost_usd), 0), 6) AS DOUBLE) END AS cost_usd,
  CASE WHEN b = {newest} THEN CAST(round(coalesce(sum(cost_usd), 0), 6) AS DOUBLE) ELSE 0.0 END AS partial_cost_usd
FROM (SELECT unnest(range({newest - length + 1}, {newest + 1})) AS b) LEFT JOIN priced ON {bucket} = b GROUP BY b"""


@query("scope_24h", with_priced(_scope_sql(_LHOUR, _THIS_HOUR, 24, "lpad(CAST(b % 24 AS VARCHAR), 2, '0')")))
def scope_24h(spark, sf):
    return out(rollups.scoped_frame(cells(spark, sf, **hours(_THIS_HOUR - 23, _THIS_HOUR, TZ_MIN)), "24H", NOW_MS, TZ_MIN))


_CIVIL = "(DATE '1970-01-01' + CAST(b AS INTEGER))"


@query("scope_30d", with_priced(_scope_sql(_DAY, _TODAY, 30, f"month({_CIVIL}) || '/' || day({_CIVIL})")))
def scope_30d(spark, sf):
    return out(rollups.scoped_frame(days_back(spark, sf, 30), "30D", NOW_MS, TZ_MIN))


@query("scope_summary", with_priced(f"""
SELECT '7D' AS scope, CAST(sum(t) AS BIGINT) AS tokens, CAST(sum(e) AS BIGINT) AS events,
  CAST(round(sum(c), 6) AS DOUBLE) AS cost_usd, CAST(round(max(c), 6) AS DOUBLE) AS peak_usd
FROM (SELECT sum(tokens) AS t, count(*) AS e, sum(cost_usd) AS c FROM priced
  WHERE {_DAY} BETWEEN {_TODAY - 6} AND {_TODAY} GROUP BY {_DAY})"""))
def scope_summary(spark, sf):
    return out(rollups.scoped_summary(days_back(spark, sf, 7), "7D", NOW_MS, TZ_MIN))


@query("scope_agents", with_priced(f"""
SELECT agent, {SUMS_SQL} FROM priced WHERE {_DAY} BETWEEN {_TODAY - 29} AND {_TODAY} GROUP BY agent"""))
def scope_agents(spark, sf):
    return out(rollups.scoped_agents(days_back(spark, sf, 30), "30D", NOW_MS, TZ_MIN))


def _top_sql(dim: str, n: int) -> str:
    return f"""
SELECT {dim}, CAST(sum(tokens) AS BIGINT) AS tokens, {SUMS_SQL} FROM priced WHERE {dim} <> '' GROUP BY {dim}
ORDER BY cost_usd DESC, tokens DESC, {dim} LIMIT {n}"""


@query("top_models_by_cost", with_priced(_top_sql("model", 10)))
def top_models_by_cost(spark, sf):
    totals = rollups.totals(cells(spark, sf).filter(F.col("model") != ""), "model")
    return out(ranking.top_by_cost(totals, "model", 10))


@query("top_sessions_by_tokens", with_priced(f"""
SELECT session_id, CAST(sum(tokens) AS BIGINT) AS tokens, {SUMS_SQL}, {COVERED_SQL} FROM priced GROUP BY session_id
ORDER BY tokens DESC, cost_usd DESC, session_id LIMIT 20"""))
def top_sessions_by_tokens(spark, sf):
    return out(verbs.top(day_cells(spark, sf, "session_id", "agent"), "session_id").drop("records"))


@query("sorted_table_with_rest", with_priced("""
, t AS (SELECT session_id AS name, sum(tokens) AS tokens, coalesce(sum(cost_usd), 0) AS c, count(*) AS events
  FROM priced GROUP BY 1),
p AS (SELECT *, row_number() OVER (ORDER BY c DESC, name) AS n FROM t)
SELECT CASE WHEN n <= 20 THEN name ELSE '(rest)' END AS name, CAST(sum(tokens) AS BIGINT) AS tokens,
  CAST(round(sum(c), 6) AS DOUBLE) AS cost_usd, CAST(sum(events) AS BIGINT) AS events, count(*) AS rows
FROM p GROUP BY 1"""))
def sorted_table_with_rest(spark, sf):
    return out(ranking.sorted_with_remainder(rollups.totals(cells(spark, sf, "session_id"), "session_id"), "session_id"))


@query("sorted_by_name", with_priced("""
SELECT project AS name, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(round(sum(cost_usd), 6) AS DOUBLE) AS cost_usd,
  count(*) AS events, 1::BIGINT AS rows FROM priced GROUP BY project"""))
def sorted_by_name(spark, sf):
    return out(ranking.sorted_with_remainder(rollups.totals(cells(spark, sf, "project"), "project"), "project", "name"))


@query("most_recent_per_agent", with_priced("""
SELECT agent, session_id, last_ms FROM (
  SELECT agent, session_id, max(ts_ms) AS last_ms, row_number() OVER (PARTITION BY agent
    ORDER BY max(ts_ms) DESC, session_id DESC) AS n FROM priced GROUP BY agent, session_id) WHERE n <= 32"""))
def most_recent_per_agent(spark, sf):
    last = usage(spark, sf).groupBy("agent", "session_id").agg(F.max("ts_ms").alias("last_ms"))
    return ranking.keep_recent(last, 32, ["agent"], ["last_ms", "session_id"])


@query("source_coverage", with_priced("""
SELECT a.agent, a.agent IN ('claude', 'codex', 'gemini') AS enabled,
  CASE WHEN a.n <= 11 THEN a.agent IN ('claude', 'codex') END AS detected, coalesce(u.e, 0) AS events,
  u.f AS first_seen_ms, u.l AS last_seen_ms
FROM (SELECT unnest(['claude','codex','opencode','pi','gemini','qwen','kimi','goose','kilo','cline','roo','copilot',
  'continue','droid']) AS agent, unnest(range(1, 15)) AS n) a
LEFT JOIN (SELECT agent, count(*) AS e, min(ts_ms // 3600000) * 3600000 AS f, max(ts_ms // 3600000) * 3600000 AS l
  FROM uses GROUP BY agent) u USING (agent)"""))
def source_coverage(spark, sf):
    from meterline.catalog.cube_queries import hour_cells
    from meterline.sources.fleet import coverage
    return coverage(hour_cells(spark, sf, "agent"), ["claude", "codex", "gemini"], {"claude": True, "codex": True})


@query("enabled_difference", with_priced("""
SELECT DISTINCT agent FROM uses WHERE agent NOT IN (SELECT agent FROM uses WHERE k < 1 AND user_id < 75)"""))
def enabled_difference(spark, sf):
    from meterline.sources.fleet import added_sources
    events = usage(spark, sf)
    return added_sources(events, events.filter((F.col("k") < 1) & (F.col("user_id") < 75)))


@query("snapshot_report", with_priced(f"""
SELECT (SELECT CAST(sum(tokens) AS BIGINT) FROM priced WHERE {_DAY} = {_TODAY}) AS today_tokens,
  (SELECT CAST(round(sum(cost_usd), 6) AS DOUBLE) FROM priced WHERE {_DAY} = {_TODAY}) AS today_cost_usd,
  (SELECT CAST(sum(tokens) AS BIGINT) FROM priced WHERE {_MONTH}) AS month_tokens,
  (SELECT CAST(round(sum(cost_usd), 6) AS DOUBLE) FROM priced) AS all_time_cost_usd,
  (SELECT count(*) FROM priced) AS all_time_events, (SELECT count(DISTINCT agent) FROM priced) AS agents_all_time,
  (SELECT round(coalesce(sum(tokens), 0) / 15.0, 6) FROM priced
    WHERE ts_ms // 60000 BETWEEN {NOW_MS // 60000 - 14} AND {NOW_MS // 60000}) AS burn_tokens_per_min,
  (SELECT count(DISTINCT ts_ms // 60000) FROM priced WHERE ts_ms // 60000 * 60000 >= {NOW_MS - 172_800_000}) AS hot_minutes,
  (SELECT model FROM (SELECT model, sum(cost_usd) AS c, sum(tokens) AS t FROM priced WHERE model <> '' GROUP BY 1)
    ORDER BY coalesce(c, 0) DESC, t DESC, model LIMIT 1) AS top_model,
  (SELECT project FROM (SELECT project, sum(cost_usd) AS c, sum(tokens) AS t FROM priced GROUP BY 1)
    ORDER BY coalesce(c, 0) DESC, t DESC, project LIMIT 1) AS top_project"""))
def snapshot_report(spark, sf):
    snapshot = report.snapshot(usage(spark, sf), NOW_MS, TZ_MIN)
    return out(snapshot.select(
        F.col("today.tokens").alias("today_tokens"), F.col("today.cost_usd").alias("today_cost_usd"),
        F.col("month.tokens").alias("month_tokens"), F.col("all_time.cost_usd").alias("all_time_cost_usd"),
        F.col("all_time.events").alias("all_time_events"), F.size("all_time.by_agent").alias("agents_all_time"),
        "burn_tokens_per_min", F.col("history.hot_minutes").alias("hot_minutes"),
        F.col("models")[0]["name"].alias("top_model"), F.col("projects")[0]["name"].alias("top_project")))


__all__ = ["_HOUR", "agents", "total_tokens"]
