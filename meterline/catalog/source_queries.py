"""Queries on ingest: logs, snapshots and ledgers rebuilt as text from the events, dedup, deltas, changes."""

from __future__ import annotations


import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.catalog.inputs import NOW_MS, out, query, read_once, usage, with_priced, with_uses
from meterline.functions.money import COST, usd
from meterline.operators import cdc, cube, dedup, quota
from meterline.operators.deltas import carry_context, cumulative_deltas
from meterline.operators.bounded import broadcast_if_small
from meterline.operators.pricing import model_rates, price_rows
from meterline.operators.scan import Running, chunk_of, ordered_scan, union_all
from meterline.schemas import TOKEN_COLUMNS
from meterline.sources import lines as line_sources
from meterline.session import scratch_folder, settled
from meterline.sources import ledgers, snapshots, tail, transcripts

_EVENT = ("agent", "ts_ms", "model", *TOKEN_COLUMNS, "session_id", "cwd")


def _iso(ms: str = "ts_ms") -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _lines(df: DataFrame, value: Column, source_file: Column) -> DataFrame:
    """Text lines with the order a split read would give them."""
    # A generator, so that the text is built once as if it had been read.
    text = df.select("event_id", source_file.alias("source_file"), F.explode(F.array(value)).alias("value"))
    return text.select("value", "source_file", chunk_of(F.col("event_id")).alias("line_start"),
                       F.col("event_id").alias("line_seq"))


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))


def _struct(**fields: Column) -> Column:
    return F.struct(*[value.alias(name) for name, value in fields.items()])


def _usage(spark, sf, u: DataFrame | None) -> DataFrame:
    """`u`, where a query over many sources has it already."""
    return usage(spark, sf) if u is None else u


def _kept(events: DataFrame) -> DataFrame:
    return dedup.keep_first(events).select(*_EVENT)


def claude_lines(spark, sf, u: DataFrame | None = None) -> DataFrame:
    """A transcript per session; every seventh row is another type, every fifth is logged twice."""
    u = _usage(spark, sf, u)
    copies = u.withColumn("copy", F.explode(F.when(F.col("k") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0)))))
    value = _json(
        type=F.when(F.col("k") % 7 == 0, "user").otherwise("assistant"), timestamp=_iso(),
        sessionId=F.col("session_id"), cwd=F.col("cwd"), requestId=F.concat(F.lit("r"), F.col("event_id").cast("string")),
        message=_struct(
            id=F.concat(F.lit("m"), F.col("event_id").cast("string")),
            model=F.when(F.col("model") == "", "<synthetic>").otherwise(F.col("model")),
            content=F.lit('"type":"assistant"'),
            usage=_struct(input_tokens=F.col("input_tokens"), output_tokens=F.col("output_tokens"),
                          cache_creation_input_tokens=F.col("cache_creation_tokens"),
                          cache_read_input_tokens=F.when(F.col("k") % 2 == 0, F.col("cache_read_tokens"))
                          .otherwise(-F.col("cache_read_tokens")))))
    name = F.concat(F.lit("/logs/"), F.col("session_id"), F.lit("-"), F.col("copy").cast("string"), F.lit(".jsonl"))
    return _lines(copies, value, name)


@query("claude_usage", with_uses("""
SELECT 'claude' AS agent, ts_ms, model, input_tokens, output_tokens, cache_creation_tokens,
  CASE WHEN k % 2 = 0 THEN cache_read_tokens ELSE 0 END AS cache_read_tokens, session_id, cwd
FROM uses WHERE k % 7 <> 0 AND model <> ''"""))
def claude_usage(spark, sf, u=None):
    return _kept(transcripts.claude(claude_lines(spark, sf, u)))


def codex_lines(spark, sf, u: DataFrame | None = None) -> DataFrame:
    """A rollout per user: every tenth k is a header, the rest are cumulative counters that restart daily."""
    u = _usage(spark, sf, u).withColumn("day_no", (F.col("ts_ms") / 86_400_000).cast("bigint"))
    header = F.col("k") % 10 == 0
    counted = ordered_scan(
        u, ["user_id", "day_no"], ["event_id"], chunk_of(F.col("event_id")),
        c_in=Running("sum", F.when(header, 0).otherwise(F.col("input_tokens"))),
        c_out=Running("sum", F.when(header, 0).otherwise(F.col("output_tokens"))),
        c_cached=Running("sum", F.when(header, 0).otherwise(F.col("input_tokens") * 3 / 4).cast("bigint")))
    meta = _json(type=F.when(F.col("k") % 20 == 0, "session_meta").otherwise("turn_context"), timestamp=_iso(),
                 payload=_struct(session_id=F.concat(F.lit("s"), F.col("event_id").cast("string")),
                                 cwd=F.col("cwd"), model=F.when(F.col("model") != "", F.col("model"))))
    info = _struct(total_token_usage=_struct(
        input_tokens=F.col("c_in"), cached_input_tokens=F.col("c_cached"), output_tokens=F.col("c_out")))
    limits = _struct(
        primary=_struct(used_percent=F.col("k").cast("double"), resets_at=(F.col("ts_ms") / 1000).cast("bigint")),
        secondary=F.when(F.col("k") % 2 == 0, _struct(used_percent=F.col("k") / 2, resets_at=F.lit(0).cast("bigint"))),
        plan_type=F.when(F.col("k") % 3 == 0, "pro"))
    reading = _json(type=F.lit("event_msg"), timestamp=_iso(), payload=_struct(
        type=F.lit("token_count"), info=info, rate_limits=F.when(F.col("k") % 8 == 1, limits)))
    name = F.concat(F.lit("/rollouts/rollout-"), F.col("session_id"), F.lit(".jsonl"))
    return _lines(counted, F.when(header, meta).otherwise(reading), name)


_CODEX_SQL = """
, kept AS (SELECT *, ts_ms // 86400000 AS day_no, k % 10 = 0 AS header FROM uses),
counted AS (SELECT *,
  sum(CASE WHEN header THEN 0 ELSE input_tokens END) OVER day AS c_in,
  sum(CASE WHEN header THEN 0 ELSE output_tokens END) OVER day AS c_out,
  sum(CASE WHEN header THEN 0 ELSE (input_tokens * 3) // 4 END) OVER day AS c_cached,
  last_value(CASE WHEN k % 20 = 0 THEN 's' || event_id END IGNORE NULLS) OVER file AS ctx_session,
  last_value(CASE WHEN header THEN cwd END IGNORE NULLS) OVER file AS ctx_cwd,
  last_value(CASE WHEN header AND model <> '' THEN model END IGNORE NULLS) OVER file AS ctx_model
  FROM kept WINDOW day AS (PARTITION BY user_id, day_no ORDER BY event_id),
    file AS (PARTITION BY user_id ORDER BY event_id)),
stepped AS (SELECT *, lag(c_in) OVER w AS p_in, lag(c_out) OVER w AS p_out, lag(c_cached) OVER w AS p_cached
  FROM counted WHERE NOT header WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
deltas AS (SELECT *, coalesce(p_in > c_in OR p_out > c_out OR p_cached > c_cached, true) AS whole FROM stepped),
turns AS (SELECT *, CAST(CASE WHEN whole THEN c_in ELSE c_in - p_in END AS BIGINT) AS d_in,
  CAST(CASE WHEN whole THEN c_out ELSE c_out - p_out END AS BIGINT) AS d_out,
  CAST(CASE WHEN whole THEN c_cached ELSE c_cached - p_cached END AS BIGINT) AS d_cached FROM deltas)
"""


@query("codex_usage", with_uses(_CODEX_SQL + """
SELECT 'codex' AS agent, ts_ms, coalesce(ctx_model, 'codex') AS model, greatest(d_in - d_cached, 0) AS input_tokens,
  d_out AS output_tokens, 0::BIGINT AS cache_creation_tokens, d_cached AS cache_read_tokens,
  coalesce(ctx_session, 'rollout-' || session_id) AS session_id, coalesce(ctx_cwd, '') AS cwd
FROM turns WHERE d_in <> 0 OR d_out <> 0 OR d_cached <> 0"""))
def codex_usage(spark, sf, u=None):
    return _kept(transcripts.codex(codex_lines(spark, sf, u), settled))


@query("codex_limits", with_uses("""
, r AS (SELECT * FROM uses WHERE k % 10 <> 0 AND k % 8 = 1)
SELECT event_id, ts_ms AS read_at_ms, CASE WHEN k % 3 = 0 THEN 'pro' END AS plan, 'five_hour' AS kind,
  k::DOUBLE AS used_percent, ts_ms // 1000 * 1000 AS resets_at_ms FROM r
UNION ALL SELECT event_id, ts_ms, CASE WHEN k % 3 = 0 THEN 'pro' END, 'weekly', k / 2.0, 0 FROM r WHERE k % 2 = 0"""))
def codex_limits(spark, sf):
    snaps = transcripts.codex_limits(codex_lines(spark, sf))
    return quota.as_readings(snaps).select(F.col("line_seq").alias("event_id"), "read_at_ms", "plan", "kind",
                                           "used_percent", "resets_at_ms")


@query("carried_context", with_uses("""
SELECT event_id, last_value(CASE WHEN k % 10 = 0 THEN model END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY event_id) AS carried_model FROM uses"""))
def carried_context(spark, sf):
    rows = usage(spark, sf).select("event_id", "user_id", "k", "model")
    return carry_context(rows, ["user_id"], ["event_id"], chunk_of(F.col("event_id")), {
        "carried_model": F.when(F.col("k") % 10 == 0, F.col("model"))}).select("event_id", "carried_model")


@query("cumulative_deltas", with_uses("""
, c AS (SELECT event_id, agent, sum(input_tokens) OVER (PARTITION BY agent, ts_ms // 86400000 ORDER BY event_id) AS a,
  sum(k) OVER (PARTITION BY agent, ts_ms // 86400000 ORDER BY event_id) AS b FROM uses),
s AS (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb FROM c WINDOW w AS (PARTITION BY agent ORDER BY event_id)),
d AS (SELECT event_id, CAST(CASE WHEN coalesce(a < pa OR b < pb, true) THEN a ELSE a - pa END AS BIGINT) AS delta_a,
  CAST(CASE WHEN coalesce(a < pa OR b < pb, true) THEN b ELSE b - pb END AS BIGINT) AS delta_b FROM s)
SELECT * FROM d WHERE delta_a <> 0 OR delta_b <> 0"""))
def cumulative(spark, sf):
    """One counter per agent: few and therefore hot keys, cut into chunks of the event order."""
    u = usage(spark, sf).withColumn("day_no", (F.col("ts_ms") / 86_400_000).cast("bigint"))
    chunk = chunk_of(F.col("event_id"))
    counted = ordered_scan(u, ["agent", "day_no"], ["event_id"], chunk,
                           a=Running("sum", F.col("input_tokens")), b=Running("sum", F.col("k")))
    return cumulative_deltas(counted, ["agent"], ["event_id"], chunk, ["a", "b"]).select("event_id", "delta_a", "delta_b")


@query("pi_usage", with_uses("""
SELECT 'pi' AS agent, ts_ms, model, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens,
  session_id, coalesce(last_value(CASE WHEN k % 10 = 0 THEN cwd END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY event_id), '') AS cwd
FROM uses QUALIFY k % 10 <> 0"""))
def pi_usage(spark, sf, u=None):
    u = _usage(spark, sf, u)
    header = _json(type=F.lit("session"), id=F.col("session_id"), timestamp=_iso(), cwd=F.col("cwd"))
    message = _json(type=F.lit("message"), id=F.col("event_id").cast("string"), timestamp=_iso(), message=_struct(
        role=F.lit("assistant"), model=F.col("model"), usage=_struct(
            input=F.col("input_tokens"), output=F.col("output_tokens"), cacheRead=F.col("cache_read_tokens"),
            cacheWrite=F.col("cache_creation_tokens"), reasoning=F.col("k"))))
    name = F.concat(F.lit("/pi/2026-01-01T00-00_"), F.col("session_id"), F.lit(".jsonl"))
    return _kept(transcripts.pi(_lines(u, F.when(F.col("k") % 10 == 0, header).otherwise(message), name), settled))


@query("gemini_usage", with_uses("""
SELECT agent, ts_ms, model, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens, session_id, cwd
FROM (SELECT 'gemini' AS agent, ts_ms, model, greatest(input_tokens - k, 0) AS input_tokens,
    output_tokens + k AS output_tokens, 0::BIGINT AS cache_creation_tokens, k AS cache_read_tokens, '' AS cwd, k AS kk,
    coalesce(last_value(CASE WHEN k % 10 = 0 THEN 'g' || event_id END IGNORE NULLS)
      OVER (PARTITION BY user_id ORDER BY event_id), session_id) AS session_id FROM uses)
WHERE kk % 10 <> 0 AND kk % 3 <> 0"""))
def gemini_usage(spark, sf, u=None):
    """Every third row has no tokens yet and counts nothing."""
    u = _usage(spark, sf, u)
    header = _json(sessionId=F.concat(F.lit("g"), F.col("event_id").cast("string")), kind=F.lit("metadata"))
    message = _json(id=F.col("event_id").cast("string"), timestamp=_iso(), type=F.lit("gemini"), model=F.col("model"),
                    tokens=F.when(F.col("k") % 3 != 0, _struct(
                        input=F.col("input_tokens"), output=F.col("output_tokens"), cached=F.col("k"),
                        thoughts=F.col("k"), tool=F.col("k"))))
    name = F.concat(F.lit("/chats/session-"), F.col("session_id"), F.lit(".jsonl"))
    return _kept(transcripts.gemini(_lines(u, F.when(F.col("k") % 10 == 0, header).otherwise(message), name), settled))


@query("qwen_usage", with_uses("""
SELECT 'qwen' AS agent, ts_ms, model, greatest(input_tokens - k, 0) AS input_tokens, output_tokens + 7 AS output_tokens,
  0::BIGINT AS cache_creation_tokens, k AS cache_read_tokens,
  CASE WHEN k % 4 = 1 THEN 'file' || user_id ELSE session_id END AS session_id, cwd FROM uses WHERE k % 6 <> 5"""))
def qwen_usage(spark, sf, u=None):
    u = _usage(spark, sf, u)
    value = _json(uuid=F.col("event_id").cast("string"), sessionId=F.when(F.col("k") % 4 != 1, F.col("session_id")),
                  timestamp=_iso(), type=F.when(F.col("k") % 6 == 5, "user").otherwise("assistant"), cwd=F.col("cwd"),
                  model=F.col("model"), usageMetadata=_struct(
                      promptTokenCount=F.col("input_tokens"), candidatesTokenCount=F.col("output_tokens"),
                      cachedContentTokenCount=F.col("k"), thoughtsTokenCount=F.lit(7)))
    name = F.concat(F.lit("/qwen/file"), F.col("user_id").cast("string"), F.lit(".jsonl"))
    return _kept(transcripts.qwen(_lines(u, value, name)))


@query("kimi_usage", with_uses("""
SELECT 'kimi' AS agent, ts_ms, '' AS model, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens,
  session_id, '' AS cwd FROM uses WHERE k % 3 <> 0 AND user_id % 10 <> 3"""))
def kimi_usage(spark, sf, u=None):
    """Status updates; every third carries no usage, and one folder in ten has another file name."""
    u = _usage(spark, sf, u)
    value = _json(timestamp=F.col("ts_ms") / 1000.0, message=_struct(type=F.lit("StatusUpdate"), payload=_struct(
        message_id=F.col("event_id").cast("string"), token_usage=F.when(F.col("k") % 3 != 0, _struct(
            input_other=F.col("input_tokens"), output=F.col("output_tokens"),
            input_cache_read=F.col("cache_read_tokens"), input_cache_creation=F.col("cache_creation_tokens"))))))
    name = F.concat(F.lit("/kimi/"), F.col("session_id"), F.when(F.col("user_id") % 10 == 3, "/context.jsonl")
                    .otherwise("/wire.jsonl"))
    return _kept(transcripts.kimi(_lines(u, value, name)))


def _documents(spark, sf, u: DataFrame | None, message: Column, wrap) -> DataFrame:
    """Rewritten JSON documents of a user: one per 256 event ids, so that no document outgrows a file."""
    u = _usage(spark, sf, u).withColumn("part_no", F.floor(F.col("event_id") / 256))
    grouped = u.groupBy("user_id", "session_id", "part_no").agg(
        F.array_sort(F.collect_list(F.struct("event_id", message.alias("m")))).alias("ms"))
    return wrap(grouped.withColumn("messages", F.transform("ms", lambda x: x["m"])))


@query("cline_records", with_uses("""
SELECT 'c' || event_id AS key, ts_ms, model, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens,
  CASE WHEN user_id % 2 = 0 THEN session_id ELSE 'f' || user_id || '-' || (event_id // 256) END AS session_id
FROM uses WHERE k % 4 <> 3"""))
def cline_records(spark, sf, u=None):
    message = _struct(
        id=F.concat(F.lit("c"), F.col("event_id").cast("string")), ts=F.col("ts_ms"), modelInfo=_struct(id=F.col("model")),
        metrics=F.when(F.col("k") % 4 != 3, _struct(
            inputTokens=F.col("input_tokens"), outputTokens=F.col("output_tokens"),
            cacheReadTokens=F.col("cache_read_tokens"), cacheWriteTokens=F.col("cache_creation_tokens"))))
    files = _documents(spark, sf, u, message, lambda d: d.select(
        _json(version=F.lit(1), sessionId=F.when(F.col("user_id") % 2 == 0, F.col("session_id")),
              messages=F.col("messages")).alias("value"),
        F.concat(F.lit("/cline/f"), F.col("user_id").cast("string"), F.lit("-"), F.col("part_no").cast("string"),
                 F.lit(".messages.json")).alias("source_file")))
    return snapshots.cline_messages(files).select("key", "ts_ms", "model", *TOKEN_COLUMNS, "session_id")


@query("task_records", with_uses("""
SELECT CAST(ts_ms AS VARCHAR) AS key, 'roo' AS agent, ts_ms, input_tokens, output_tokens, cache_creation_tokens,
  cache_read_tokens, session_id FROM uses WHERE k % 5 <> 2"""))
def task_records(spark, sf, u=None):
    inner = _json(request=F.lit("..."), tokensIn=F.col("input_tokens"), tokensOut=F.col("output_tokens"),
                  cacheWrites=F.col("cache_creation_tokens"), cacheReads=F.col("cache_read_tokens"))
    message = _struct(ts=F.col("ts_ms"), type=F.lit("say"), text=inner,
                      say=F.when(F.col("k") % 5 == 2, "text").when(F.col("k") % 5 == 1, "deleted_api_reqs")
                      .otherwise("api_req_started"))
    files = _documents(spark, sf, u, message, lambda d: d.select(
        F.to_json("messages").alias("value"),
        F.concat(F.lit("/tasks/"), F.col("part_no").cast("string"), F.lit("/"), F.col("session_id"),
                 F.lit("/ui_messages.json")).alias("source_file")))
    return snapshots.task_messages(files, "roo").select("key", "agent", "ts_ms", *TOKEN_COLUMNS, "session_id")


@query("quota_responses", with_uses("""
SELECT event_id AS seq, ts_ms AS read_at_ms, 'five_hour' AS kind, k::DOUBLE AS used_percent, ts_ms AS resets_at_ms FROM uses
UNION ALL SELECT event_id, ts_ms, 'weekly_opus', k / 4.0, 0 FROM uses WHERE k % 2 = 0"""))
def quota_responses(spark, sf):
    u = usage(spark, sf)
    body = _json(five_hour=_struct(utilization=F.col("k").cast("double"), resets_at=_iso()),
                 seven_day=F.lit(None).cast("string"),
                 seven_day_opus=F.when(F.col("k") % 2 == 0, _struct(utilization=F.col("k") / 4, resets_at=F.lit("soon"))))
    landed = u.select(F.col("event_id").alias("seq"), F.col("ts_ms").alias("read_at_ms"), F.lit("").alias("plan"),
                      body.alias("body"))
    return quota.as_readings(snapshots.quota_responses(landed)).select(
        "seq", "read_at_ms", "kind", "used_percent", "resets_at_ms")


@query("goose_usage", with_uses("""
SELECT event_id AS row_id, 'goose' AS agent, ts_ms // 1000 * 1000 AS ts_ms, model, input_tokens,
  CASE WHEN k % 2 = 0 THEN output_tokens ELSE 0 END AS output_tokens, 0::BIGINT AS cache_creation_tokens,
  0::BIGINT AS cache_read_tokens, session_id
FROM uses WHERE event_id > 500 AND k % 8 <> 3 AND (input_tokens > 0 OR (k % 2 = 0 AND output_tokens > 0))"""))
def goose_usage(spark, sf):
    """Rows as the ledger reader hands them over: gaps, negative counters and rows without a model."""
    none = F.lit(None).cast("bigint")
    rows = usage(spark, sf).select(
        F.lit("g.db").alias("db_file"), F.col("event_id").alias("row_id"), "session_id",
        F.expr("ts_ms div 1000").alias("created_timestamp"), F.when(F.col("k") % 8 != 3, F.col("model")).alias("model"),
        "input_tokens", F.when(F.col("k") % 2 == 0, F.col("output_tokens")).otherwise(-F.col("output_tokens")).alias("output_tokens"),
        none.alias("cache_read_tokens"), none.alias("cache_write_tokens"))
    return ledgers.goose(rows, above_row=500).select("row_id", "agent", "ts_ms", "model", *TOKEN_COLUMNS, "session_id")


def _messages(u: DataFrame, data: Column) -> DataFrame:
    return u.select(
        F.lit("m.db").alias("db_file"), F.col("event_id").alias("row_id"), F.col("event_id").cast("string").alias("id"),
        "session_id", F.col("ts_ms").alias("time_created"), (F.col("ts_ms") + 1).alias("time_updated"),
        F.explode(F.array(data)).alias("data"))


def _tokens_json(reasoning: Column) -> Column:
    return _struct(input=F.col("input_tokens"), output=F.col("output_tokens"), reasoning=reasoning, cache=_struct(
        read=F.col("cache_read_tokens"), write=F.col("cache_creation_tokens")))


@query("kilo_usage", with_uses("""
SELECT CAST(event_id AS VARCHAR) AS id, ts_ms, CASE WHEN k % 3 = 0 THEN 'own-' || k ELSE 'of-' || session_id END AS model,
  input_tokens, output_tokens + k AS output_tokens, cache_creation_tokens, cache_read_tokens, session_id
FROM uses WHERE k % 5 <> 1 AND (k % 3 = 0 OR user_id < 100)"""))
def kilo_usage(spark, sf):
    """The model is the message's own or its session's; sessions of users from 100 on are unknown."""
    u = usage(spark, sf)
    data = _json(role=F.when(F.col("k") % 5 == 1, "user").otherwise("assistant"), model=F.when(F.col("k") % 3 == 0, _struct(
        id=F.concat(F.lit("own-"), F.col("k").cast("string")))), tokens=_tokens_json(F.col("k")))
    sessions = u.filter(F.col("user_id") < 100).select(
        F.lit("m.db").alias("db_file"), F.col("session_id").alias("id"),
        _json(id=F.concat(F.lit("of-"), F.col("session_id"))).alias("model")).distinct()
    return ledgers.kilo(_messages(u, data), sessions).select("id", "ts_ms", "model", *TOKEN_COLUMNS, "session_id")


@query("opencode_usage", with_uses("""
SELECT CAST(event_id AS VARCHAR) AS key, CASE WHEN k % 2 = 0 THEN ts_ms + 5 ELSE ts_ms END AS ts_ms, 'x-' || model AS model,
  input_tokens, output_tokens + 1 AS output_tokens, cache_creation_tokens, cache_read_tokens, session_id, '/d' || user_id AS cwd
FROM uses WHERE k % 7 <> 2 AND k % 5 <> 1 AND user_id < 120"""))
def opencode_usage(spark, sf):
    """Rows of the first schema; every fifth k has a broken counter, sessions of users from 120 on are missing."""
    u = usage(spark, sf)
    data = _json(role=F.when(F.col("k") % 7 == 2, "user").otherwise("assistant"),
                 modelID=F.concat(F.lit("x-"), F.col("model")),
                 time=_struct(completed=F.when(F.col("k") % 2 == 0, F.col("ts_ms") + 5)),
                 tokens=_tokens_json(F.when(F.col("k") % 5 == 1, -1.5).otherwise(1).cast("string")))
    data = F.regexp_replace(data, '"reasoning":"([^"]*)"', '"reasoning":$1')
    data = F.replace(data, F.lit('"reasoning":1.0'), F.lit('"reasoning":1'))
    messages = _messages(u, data)
    following = messages.limit(0).withColumn("type", F.lit("assistant"))
    sessions = u.filter(F.col("user_id") < 120).select(
        F.lit("m.db").alias("db_file"), F.col("session_id").alias("id"),
        F.concat(F.lit("/d"), F.col("user_id").cast("string")).alias("directory")).distinct()
    return ledgers.opencode(messages, following, sessions).select(
        "key", "ts_ms", "model", *TOKEN_COLUMNS, "session_id", "cwd")


def _as_growth(records: DataFrame, agent: str) -> DataFrame:
    """Records of rewritten documents as additive rows, next to the rows of logs: a first snapshot only adds."""
    fields = ("agent", "ts_ms", *TOKEN_COLUMNS, "cost_usd")
    versions = records.withColumns({"agent": F.lit(agent), "cost_usd": F.lit(None).cast(COST)})
    keys = ["session_id", "key"]
    newest = cdc.last_in_snapshot(versions, keys, ["ts_ms"])
    return cdc.delta_events(cdc.changes(versions.limit(0), newest, keys, fields))


@query("all_sources", with_uses(_CODEX_SQL + """
SELECT agent, count(*) AS events, CAST(sum(tokens) AS BIGINT) AS tokens FROM (
  SELECT 'claude' AS agent, input_tokens + output_tokens + cache_creation_tokens
    + CASE WHEN k % 2 = 0 THEN cache_read_tokens ELSE 0 END AS tokens FROM uses WHERE k % 7 <> 0 AND model <> ''
  UNION ALL SELECT 'codex', greatest(d_in - d_cached, 0) + d_out + d_cached FROM turns WHERE d_in <> 0 OR d_out <> 0 OR d_cached <> 0
  UNION ALL SELECT 'pi', tokens FROM uses WHERE k % 10 <> 0
  UNION ALL SELECT 'gemini', greatest(input_tokens - k, 0) + output_tokens + k + k FROM uses WHERE k % 10 <> 0 AND k % 3 <> 0
  UNION ALL SELECT 'qwen', greatest(input_tokens - k, 0) + output_tokens + 7 + k FROM uses WHERE k % 6 <> 5
  UNION ALL SELECT 'kimi', tokens FROM uses WHERE k % 3 <> 0 AND user_id % 10 <> 3
  UNION ALL SELECT 'cline', tokens FROM uses WHERE k % 4 <> 3
  UNION ALL SELECT 'roo', tokens FROM uses WHERE k % 5 <> 2)
GROUP BY agent"""))
def all_sources(spark, sf):
    """Every source that needs no database: six logs, and two of rewritten documents through change capture."""
    u = read_once(spark, sf)
    logs = [q(spark, sf, u) for q in (claude_usage, codex_usage, pi_usage, gemini_usage, qwen_usage, kimi_usage)]
    rewritten = [_as_growth(cline_records(spark, sf, u), "cline"), _as_growth(task_records(spark, sf, u), "roo")]
    merged = union_all([f.select("agent", *TOKEN_COLUMNS) for f in logs + rewritten])
    tokens = sum((F.col(c) for c in TOKEN_COLUMNS), F.lit(0))
    return merged.groupBy("agent").agg(F.count("*").alias("events"), F.sum(tokens).alias("tokens"))


@query("line_prefilter", with_uses("SELECT count(*) AS lines FROM uses WHERE k % 10 <> 0"))
def line_prefilter(spark, sf):
    return line_sources.may_matter(codex_lines(spark, sf), ["token_count"]).agg(F.count("*").alias("lines"))


@query("not_yet_stored", with_uses("""
SELECT event_id FROM uses WHERE k % 3 <> 0 OR k % 11 = 0"""))
def not_yet_stored(spark, sf):
    """Keys with k divisible by 3 were stored by an earlier run; unkeyed rows always pass."""
    u = usage(spark, sf)
    keyed = u.select("agent", "event_id", "k", F.lit("f").alias("source_file"), F.lit(0).alias("line_start"),
                     F.col("event_id").alias("line_seq"), F.when(F.col("k") % 11 != 0, F.concat(
        F.lit("m"), F.col("event_id").cast("string"))).alias("dedup_key"))
    stored = keyed.filter((F.col("k") % 3 == 0) & F.col("dedup_key").isNotNull())
    return dedup.not_yet_stored(keyed, stored).select("event_id")


_MARK = NOW_MS // 3_600_000


@query("above_mark", with_uses(f"""
SELECT event_id FROM uses WHERE ts_ms // 3600000 > {_MARK} OR (ts_ms // 3600000 = {_MARK} AND k % 2 = 1)"""))
def above_mark(spark, sf):
    """Update times in whole hours, so the mark has ties; even k were read before."""
    rows = usage(spark, sf).select("event_id", "k", (F.col("ts_ms") / 3_600_000).cast("bigint").alias("time_updated"))
    seen = rows.filter((F.col("time_updated") == _MARK) & (F.col("k") % 2 == 0))
    return dedup.above_mark(rows, _MARK, seen, id_column="event_id").select("event_id")


@query("next_mark", with_uses("""
SELECT ts_ms // 3600000 AS time_updated, event_id FROM uses
WHERE ts_ms // 3600000 = (SELECT max(ts_ms // 3600000) FROM uses)"""))
def next_mark(spark, sf):
    rows = usage(spark, sf).select("event_id", (F.col("ts_ms") / 3_600_000).cast("bigint").alias("time_updated"))
    return dedup.next_mark(rows, id_column="event_id")


@query("changed_files", with_uses("""
SELECT 'f' || event_id AS path FROM uses WHERE k % 3 = 0 OR k % 5 = 0"""))
def changed_files(spark, sf):
    """Files seen before unless k divides by 3; those that divide by 5 have grown since."""
    u = usage(spark, sf)
    listed = u.select("k", F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("path"),
                      F.timestamp_millis("ts_ms").alias("modificationTime"), F.col("input_tokens").alias("length"))
    known = listed.filter(F.col("k") % 3 != 0).withColumn(
        "length", F.when(F.col("k") % 5 == 0, F.col("length") - 1).otherwise(F.col("length")))
    return dedup.changed_files(listed, known).select("path")


@query("message_session_join", with_uses("""
SELECT event_id, session_id, CASE WHEN user_id < 100 THEN '/dir/' || user_id END AS directory FROM uses"""))
def message_session_join(spark, sf):
    u = usage(spark, sf)
    sessions = u.select("session_id", F.concat(F.lit("/dir/"), F.col("user_id").cast("string")).alias("directory"),
                        "user_id").filter(F.col("user_id") < 100).drop("user_id").distinct()
    return u.join(sessions, "session_id", "left").select("event_id", "session_id", "directory")


# --- change capture -------------------------------------------------------------------

def versions(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Version 1: every event. Version 2: the even k again, of which every third k costs more."""
    u = usage(spark, sf).withColumn("key", F.col("event_id").cast("string"))
    first = u.select("agent", "key", "project", *cdc.VERSION_FIELDS)
    grown = u.withColumn("input_tokens", F.when(F.col("k") % 3 == 0, F.floor(F.col("input_tokens") * 3 / 2).cast("bigint"))
                         .otherwise(F.col("input_tokens"))).withColumn(
        "output_tokens", F.when(F.col("k") % 3 == 0, F.col("output_tokens") - 5).otherwise(F.col("output_tokens")))
    second = grown.filter(F.col("k") % 2 == 0).select("agent", "key", "project", *cdc.VERSION_FIELDS)
    return first, second


_FIELDS = ("project", *cdc.VERSION_FIELDS)
_V2 = "k % 2 = 0 AND k % 3 = 0"
_NEW_IN = "CAST(floor(input_tokens * 3 / 2) AS BIGINT)"


@query("snapshot_changes", with_uses(f"""
SELECT agent, CAST(event_id AS VARCHAR) AS key, 'replace' AS op, input_tokens AS old_input, {_NEW_IN} AS new_input,
  output_tokens AS old_output, output_tokens - 5 AS new_output FROM uses WHERE {_V2}"""))
def snapshot_changes(spark, sf):
    first, second = versions(spark, sf)
    found = cdc.changes(first, second, ["agent", "key"], _FIELDS)
    return found.select("agent", "key", "op", F.col("prev.input_tokens").alias("old_input"),
                        F.col("curr.input_tokens").alias("new_input"), F.col("prev.output_tokens").alias("old_output"),
                        F.col("curr.output_tokens").alias("new_output"))


@query("merged_versions", with_uses(f"""
SELECT agent, CAST(event_id AS VARCHAR) AS key, CASE WHEN {_V2} THEN {_NEW_IN} ELSE input_tokens END AS input_tokens
FROM uses"""))
def merged_versions(spark, sf):
    first, second = versions(spark, sf)
    return cdc.merged(first, second, ["agent", "key"]).select("agent", "key", "input_tokens")


@query("version_log_changes", with_uses("""
, s AS (SELECT event_id, user_id, k % 4 AS v, lag(k % 4) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM uses)
SELECT event_id, user_id, CASE WHEN p IS NULL THEN 'add' ELSE 'replace' END AS op, p AS old_value, v AS new_value
FROM s WHERE p IS DISTINCT FROM v"""))
def version_log_changes(spark, sf):
    log = usage(spark, sf).select("event_id", "user_id", (F.col("k") % 4).alias("v"))
    found = cdc.version_changes(log, ["user_id"], "event_id", chunk_of(F.col("event_id")), ("v",))
    return found.select("event_id", "user_id", "op", F.col("prev.v").alias("old_value"), F.col("curr.v").alias("new_value"))


@query("last_in_snapshot", with_uses("""
SELECT session_id, k, max(event_id) AS event_id FROM uses GROUP BY session_id, k"""))
def last_in_snapshot(spark, sf):
    records = usage(spark, sf).select("session_id", "k", "event_id")
    return cdc.last_in_snapshot(records, ["session_id", "k"], ["event_id"])


def priced_changes(spark, sf) -> DataFrame:
    first, second = versions(spark, sf)
    columns = (*_FIELDS, "cost_usd")
    rates = sized_rates(spark, sf)
    return cdc.changes(price_rows(first, rates=rates), price_rows(second, rates=rates), ["agent", "key"], columns)


def sized_rates(spark, sf) -> DataFrame:
    """Rates of the distinct models, sized once for all joins of a query."""
    return broadcast_if_small(model_rates(usage(spark, sf)))


_SIDES = """
, cost2 AS (SELECT p.*, CAST(round(CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN cost_usd
    + CAST(CAST(CAST(floor(p.input_tokens * 3 / 2) AS BIGINT) - p.input_tokens AS DECIMAL(19,0)) * CAST(ri AS DECIMAL(18,12)) AS DECIMAL(30,12))
    - CAST(CAST(5 AS DECIMAL(19,0)) * CAST(ro AS DECIMAL(18,12)) AS DECIMAL(30,12)) ELSE cost_usd END, 12) AS DECIMAL(38,12)) AS new_cost,
  FROM priced p LEFT JOIN rates r ON r.model = p.model)
"""


@query("applied_changes", with_priced(_SIDES + f"""
SELECT project, CAST(sum(CASE WHEN {_V2} THEN {_NEW_IN} ELSE input_tokens END) AS BIGINT) AS input_tokens,
  CAST(sum(CASE WHEN {_V2} THEN output_tokens - 5 ELSE output_tokens END) AS BIGINT) AS output_tokens,
  CAST(sum(cache_creation_tokens) AS BIGINT) AS cache_creation_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens,
  count(*) AS events, CAST(round(sum(coalesce(new_cost, 0)), 6) AS DOUBLE) AS cost_usd
FROM cost2 GROUP BY project"""))
def applied_changes(spark, sf):
    """Totals per project after retracting the old versions and adding the new ones."""
    first, second = versions(spark, sf)
    return out(cdc.applied_versions(first, cdc.changes(first, second, ["agent", "key"], _FIELDS), ["project"]))


@query("delta_events", with_priced(_SIDES + f"""
SELECT CAST(sum({_NEW_IN} - input_tokens) AS BIGINT) AS input_tokens, 0::BIGINT AS output_tokens, count(*) AS events,
  count(new_cost) AS priced_events, CAST(round(sum(new_cost - cost_usd), 6) AS DOUBLE) AS cost_usd, model
FROM cost2 WHERE {_V2} GROUP BY model"""))
def delta_events(spark, sf):
    """Growth only: fewer output tokens count nothing, and each change is one more event."""
    rows = cdc.delta_events(priced_changes(spark, sf))
    return rows.groupBy("model").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("events").alias("events"), F.count("cost_usd").alias("priced_events"),
        usd(F.sum("cost_usd").cast(COST)).alias("cost_usd"))


def _written(rows: pd.DataFrame, folder: str, share: float) -> pd.DataFrame:
    """Write each row's `text` as a file, the first `share` of its bytes; a later call makes the file grow."""
    system, root = pafs.FileSystem.from_uri(folder)
    for name, text in zip(rows["name"], rows["text"], strict=True):
        data = text.encode()
        system.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
        with system.open_output_stream(f"{root}/{name}") as out:
            out.write(data[:int(len(data) * share)])
    return rows[["name"]]


@query("grown_logs", with_uses("""
SELECT 'claude' AS agent, count(*) AS events, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum(cache_creation_tokens) AS BIGINT) AS cache_creation_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens
FROM uses WHERE k % 2 = 0 AND model <> ''
UNION ALL SELECT 'codex', count(*), CAST(sum(input_tokens) AS BIGINT), CAST(sum(output_tokens) AS BIGINT), 0, 0
FROM uses WHERE k % 2 = 1"""))
def grown_logs(spark, sf):
    """Logs of 256 events, cut inside a line, taken in, grown, taken in again, and swept a third time unchanged."""
    u = usage(spark, sf).withColumn("part_no", F.expr("event_id div 256"))
    odd = F.col("k") % 2 == 1
    counted = ordered_scan(u.withColumn("odd", odd), ["odd", "part_no"], ["event_id"], F.lit(0).cast("bigint"),
                           c_in=Running("sum", F.col("input_tokens")), c_out=Running("sum", F.col("output_tokens")))
    claude_line = _json(type=F.lit("assistant"), timestamp=_iso(), sessionId=F.col("session_id"), cwd=F.col("cwd"),
                        requestId=F.col("event_id").cast("string"), message=_struct(
        id=F.col("event_id").cast("string"), model=F.when(F.col("model") != "", F.col("model")), usage=_struct(
            input_tokens=F.col("input_tokens"), output_tokens=F.col("output_tokens"),
            cache_creation_input_tokens=F.col("cache_creation_tokens"), cache_read_input_tokens=F.col("cache_read_tokens"))))
    codex_line = _json(type=F.lit("event_msg"), timestamp=_iso(), payload=_struct(type=F.lit("token_count"), info=_struct(
        total_token_usage=_struct(input_tokens=F.col("c_in"), cached_input_tokens=F.lit(0), output_tokens=F.col("c_out")))))
    text = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.when(
        F.col("odd"), codex_line).otherwise(claude_line).alias("line")))), lambda x: x["line"]), "\n"), F.lit("\n"))
    logs = settled(counted.groupBy("odd", "part_no").agg(text.alias("text")).select(F.concat(
        F.when(F.col("odd"), "codex/").otherwise("claude/"), "part_no", F.lit(".jsonl")).alias("name"), "text"))
    root = scratch_folder(spark, "grown")
    paths = {"claude": f"{root}/logs/claude", "codex": f"{root}/logs/codex"}
    for generation, share in enumerate((0.6, 1.0, 1.0), start=1):
        folder = f"{root}/logs"
        logs.mapInPandas(lambda batches, share=share: (_written(b, folder, share) for b in batches), "name string").count()
        status = tail.sweep_into_cube(spark, paths, f"{root}/store", generation)
        assert status.filter("ok").count() == len(paths), status.collect()
    cells = cube.read_tier(spark, f"{root}/store", "hour")
    return cells.groupBy("agent").agg(F.sum("events").alias("events"), *[F.sum(c).alias(c) for c in TOKEN_COLUMNS])


@query("corpus_size", with_uses("""
SELECT count(DISTINCT user_id % 5) AS files, CAST(sum(strlen('{"id":' || event_id || ',"model":"' || model || '"}') + 1) AS BIGINT) AS bytes FROM uses"""))
def corpus_size(spark, sf):
    """Files of a log that the query writes, by their listing: how many, and the bytes that their lines add up to."""
    line = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"model":"'), F.col("model"), F.lit('"}'))
    texts = settled(usage(spark, sf).groupBy((F.col("user_id") % 5).alias("part")).agg(
        F.concat(F.array_join(F.array_sort(F.collect_list(line)), "\n"), F.lit("\n")).alias("text")).select(
        F.concat(F.lit("part-"), "part", F.lit(".jsonl")).alias("name"), "text"))
    folder = scratch_folder(spark, "sized")
    texts.mapInPandas(lambda batches: (_written(b, folder, 1.0) for b in batches), "name string").count()
    return line_sources.corpus_size(spark, folder)
