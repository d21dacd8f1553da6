"""Rewritten JSON documents -> keyed records (SRC13, SRC14), and quota responses (SRC15)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions.paths import file_stem, parent_name
from meterline.functions.timecols import iso_to_ms
from meterline.schemas import TOKEN_COLUMNS
from meterline.sources.lines import once
from meterline.sources.transcripts import count_of, text_of

RECORD = ("source_file", "key", "position", "agent", "ts_ms", "model", *TOKEN_COLUMNS, "session_id", "cwd")
_COUNTERS = "inputTokens bigint, outputTokens bigint, cacheReadTokens bigint, cacheWriteTokens bigint"
_LEGACY_COUNTERS = "tokensIn bigint, tokensOut bigint, cacheWrites bigint, cacheReads bigint"


def _records(df: DataFrame, agent: str, **columns: Column) -> DataFrame:
    values = {"source_file": F.col("source_file"), "position": F.col("position"),
              "agent": F.lit(agent), "cwd": F.lit(""), **columns}
    rows = df.select(*[values[c].alias(c) for c in RECORD])
    return rows.filter(sum((F.col(c) for c in TOKEN_COLUMNS), F.lit(0)) > 0)


def cline_messages(files: DataFrame, agent: str = "cline") -> DataFrame:
    """`*.messages.json`: an object whose messages carry an id and metrics."""
    parsed = once(files, j=F.from_json("value", (
        "sessionId string, messages array<struct<id string, ts bigint, modelInfo struct<id string>, "
        f"metrics struct<{_COUNTERS}>>>")))
    rows = parsed.select("source_file", F.col("j.sessionId").alias("session"),
                         F.posexplode("j.messages").alias("position", "m"))
    kept = rows.filter((text_of(F.col("m.id")) != "") & F.col("m.metrics").isNotNull())
    own = text_of(F.col("session"))
    return _records(
        kept, agent, key=F.col("m.id"), ts_ms=F.coalesce("m.ts", F.lit(0).cast("bigint")),
        model=text_of(F.col("m.modelInfo.id")),
        input_tokens=count_of(F.col("m.metrics.inputTokens")),
        output_tokens=count_of(F.col("m.metrics.outputTokens")),
        cache_creation_tokens=count_of(F.col("m.metrics.cacheWriteTokens")),
        cache_read_tokens=count_of(F.col("m.metrics.cacheReadTokens")),
        session_id=F.when(own != "", own).otherwise(file_stem(F.col("source_file"), ".messages.json")))


def task_messages(files: DataFrame, agent: str) -> DataFrame:
    """`ui_messages.json` of a task folder: request rows whose `text` is JSON itself."""
    parsed = once(files, j=F.from_json(
        "value", "array<struct<ts bigint, type string, say string, text string>>"))
    rows = parsed.select("source_file", F.posexplode("j").alias("position", "m"))
    kept = once(rows.filter(
        (F.col("m.type") == "say") & F.col("m.say").isin("api_req_started", "deleted_api_reqs")
        & F.col("m.ts").isNotNull()), u=F.from_json("m.text", _LEGACY_COUNTERS))
    # A counter that is an object, a list or a boolean makes the row no request.
    odd = reduce(lambda a, b: a | b, [
        F.coalesce(F.get_json_object("m.text", f"$.{c}").rlike(r"^(\{|\[|true$|false$)"), F.lit(False))
        for c in ("tokensIn", "tokensOut", "cacheWrites", "cacheReads")])
    # A text that has none of these beyond its first character holds no such value: it is not parsed again for every counter.
    inner = F.substring("m.text", 2, 2**31 - 1)
    may_be_odd = reduce(lambda a, b: a | b, [inner.contains(part) for part in ("{", "[", "true", "false", "\\")])
    return _records(
        kept.filter(F.col("u").isNotNull() & ~F.when(may_be_odd, odd).otherwise(F.lit(False))), agent, key=F.col("m.ts").cast("string"), ts_ms=F.col("m.ts"),
        model=F.lit(""), input_tokens=count_of(F.col("u.tokensIn")),
        output_tokens=count_of(F.col("u.tokensOut")),
        cache_creation_tokens=count_of(F.col("u.cacheWrites")),
        cache_read_tokens=count_of(F.col("u.cacheReads")), session_id=parent_name(F.col("source_file")))


# Key of the response, kind of the window.
RESPONSE_WINDOWS = [("five_hour", "five_hour"), ("seven_day", "weekly"),
                    ("seven_day_opus", "weekly_opus"), ("seven_day_sonnet", "weekly_sonnet")]


def quota_responses(responses: DataFrame, agent: str = "claude") -> DataFrame:
    """Landed quota responses (seq, read_at_ms, plan, body) -> snapshots; null windows are left out."""
    fields = ", ".join(f"{k} struct<utilization double, resets_at string>" for k, _ in RESPONSE_WINDOWS)
    parsed = once(responses, j=F.from_json("body", fields)).filter(F.col("j").isNotNull())
    windows = [F.when(F.col(f"j.{key}.utilization").isNotNull(), F.struct(
        F.lit(kind).alias("kind"), F.col(f"j.{key}.utilization").alias("used_percent"),
        F.coalesce(iso_to_ms(F.col(f"j.{key}.resets_at")), F.lit(0).cast("bigint")).alias("resets_at_ms")))
        for key, kind in RESPONSE_WINDOWS]
    return parsed.select(F.lit(agent).alias("agent"), "seq", "read_at_ms", "plan",
                         F.array_compact(F.array(*windows)).alias("windows"))
