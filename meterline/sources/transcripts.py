"""Append-only transcripts -> usage events (SRC3-SRC9).

Every function takes lines (value, source_file, line_start, line_seq) and returns
usage events with a `dedup_key`; wrong types read as absent and malformed rows
are skipped. None of them removes duplicates: that is one job over all sources.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions.paths import file_name, file_stem, parent_name
from meterline.functions.timecols import iso_to_ms
from meterline.operators.deltas import carry_context, counter_deltas
from meterline.operators.scan import Running, ordered_scan
from meterline.sources.lines import ORDER, may_matter, once

CODEX_DEFAULT_MODEL = "codex"
FIELDS = ("agent", "ts_ms", "model", "input_tokens", "output_tokens", "cache_creation_tokens",
          "cache_read_tokens", "session_id", "cwd", "dedup_key", "source_file", *ORDER)


# What to do with parsed header and usage rows before they are scanned in file order: nothing,
# or `session.settled`, so that a large raw log is read and parsed once instead of twice.
Stage = Callable[[DataFrame], DataFrame]


def as_is(rows: DataFrame) -> DataFrame:
    return rows


def count_of(value: Column) -> Column:
    """A token counter: absent, negative or wrongly typed reads as 0."""
    return F.greatest(F.coalesce(value, F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))


def text_of(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _present(value: Column, default: Column) -> Column:
    return F.when(text_of(value) != "", value).otherwise(default)


def _parsed(lines: DataFrame, schema: str, markers: list[str]) -> DataFrame:
    return once(may_matter(lines, markers), j=F.from_json("value", schema)).filter(
        F.col("j").isNotNull()).drop("value")


def _context(df: DataFrame, **context: Column) -> DataFrame:
    """Header values carried to the later lines of the same file, split by split."""
    return carry_context(df, ["source_file"], ORDER, F.col("line_start"), context)


def _events(df: DataFrame, agent: str, **columns: Column) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    defaults = {"agent": F.lit(agent), "cache_creation_tokens": zero, "cwd": F.lit(""),
                "dedup_key": F.lit(None).cast("string"), "source_file": F.col("source_file"),
                **{c: F.col(c) for c in ORDER}}
    return df.select(*[{**defaults, **columns}[f].alias(f) for f in FIELDS]).filter(
        F.col("ts_ms").isNotNull())


def claude(lines: DataFrame) -> DataFrame:
    rows = _parsed(lines, (
        "type string, timestamp string, sessionId string, session_id string, cwd string, "
        "requestId string, message struct<id string, model string, usage struct<"
        "input_tokens bigint, output_tokens bigint, cache_creation_input_tokens bigint, "
        "cache_read_input_tokens bigint>>"),
        ['"type":"assistant"', '"type": "assistant"'])
    kept = rows.filter(
        (F.col("j.type") == "assistant") & F.col("j.message.model").isNotNull()
        & (F.col("j.message.model") != "<synthetic>") & F.col("j.message.usage").isNotNull()
        & F.col("j.message.id").isNotNull())
    usage = "j.message.usage"
    return _events(
        kept, "claude", ts_ms=iso_to_ms(F.col("j.timestamp")), model=F.col("j.message.model"),
        input_tokens=count_of(F.col(f"{usage}.input_tokens")),
        output_tokens=count_of(F.col(f"{usage}.output_tokens")),
        cache_creation_tokens=count_of(F.col(f"{usage}.cache_creation_input_tokens")),
        cache_read_tokens=count_of(F.col(f"{usage}.cache_read_input_tokens")),
        session_id=F.coalesce("j.sessionId", "j.session_id", F.lit("")), cwd=text_of(F.col("j.cwd")),
        dedup_key=F.concat_ws(":", "j.message.id", "j.requestId"))


_CODEX_SCHEMA = (
    "type string, timestamp string, payload struct<type string, session_id string, cwd string, "
    "model string, info struct<total_token_usage struct<input_tokens bigint, "
    "cached_input_tokens bigint, output_tokens bigint>>, rate_limits struct<"
    "primary struct<used_percent double, resets_at bigint>, "
    "secondary struct<used_percent double, resets_at bigint>, plan_type string>>")
_CODEX_MARKERS = ["token_count", "session_meta", "turn_context"]


def codex(lines: DataFrame, stage: Stage = as_is) -> DataFrame:
    """Headers carry forward and counters are differenced in one scan of the parsed lines.

    A reading without a usable input or output counter does not become a base.
    """
    usage = "j.payload.info.total_token_usage"
    at = F.col("at")
    meta, turn = F.col("j.type") == "session_meta", F.col("j.type") == "turn_context"
    usable = ((F.col("j.type") == "event_msg") & (F.col("j.payload.type") == "token_count")
              & (F.col(f"{usage}.input_tokens") >= 0) & (F.col(f"{usage}.output_tokens") >= 0) & at.isNotNull())
    parsed = once(_parsed(lines, _CODEX_SCHEMA, _CODEX_MARKERS), at=iso_to_ms(F.col("j.timestamp")))
    rows = stage(parsed.select(
        "source_file", *ORDER, at.alias("ts_ms"),
        F.when(meta, F.col("j.payload.session_id")).alias("session"),
        F.when(meta | turn, F.col("j.payload.cwd")).alias("cwd"),
        F.when(meta | turn, F.col("j.payload.model")).alias("model"),
        F.when(usable, F.struct(
            F.col(f"{usage}.input_tokens").alias("input"),
            count_of(F.col(f"{usage}.cached_input_tokens")).alias("cached"),
            F.col(f"{usage}.output_tokens").alias("output"))).alias("reading")))
    scanned = ordered_scan(
        rows, ["source_file"], ORDER, F.col("line_start"),
        ctx_session=Running("last", F.col("session")), ctx_cwd=Running("last", F.col("cwd")),
        ctx_model=Running("last", F.col("model")), prev=Running("last_before", F.col("reading")))
    turns = counter_deltas(scanned.filter(F.col("reading").isNotNull()), "reading", "prev",
                           ["input", "cached", "output"])
    stem = file_stem(F.col("source_file"), ".jsonl")
    named = F.when(F.length(stem) >= 36, F.right(stem, F.lit(36))).otherwise(stem)
    return _events(
        turns, "codex", ts_ms=F.col("ts_ms"), model=_present(F.col("ctx_model"), F.lit(CODEX_DEFAULT_MODEL)),
        input_tokens=F.greatest(F.col("delta_input") - F.col("delta_cached"), F.lit(0).cast("bigint")),
        output_tokens=F.col("delta_output"), cache_read_tokens=F.col("delta_cached"),
        session_id=_present(F.col("ctx_session"), named), cwd=text_of(F.col("ctx_cwd")))


def _speaking(lines: DataFrame, schema: str, markers: list[str], told: dict[str, Callable[[], Column]]) -> DataFrame:
    """Per file and thing told the last line that tells it: what a reading that goes on later has to know of earlier lines.

    Lines as they are (source_file, value, line_start, line_seq), so that a parser reads them like any other.
    """
    parsed = once(may_matter(lines, markers), j=F.from_json("value", schema)).filter(F.col("j").isNotNull())
    at = F.struct(*ORDER, "value")
    last = parsed.groupBy("source_file").agg(*[
        F.max_by(at, F.when(of().isNotNull(), F.struct(*ORDER))).alias(name) for name, of in told.items()])
    kept = F.array_distinct(F.array_compact(F.array(*told)))
    return last.select("source_file", F.explode(kept).alias("l")).select("source_file", "l.value", *[f"l.{c}" for c in ORDER])


def codex_speaks(lines: DataFrame) -> DataFrame:
    """The lines that hold the session, directory, model and counters that later lines go on from."""
    usage = "j.payload.info.total_token_usage"

    def header(kinds: tuple[str, ...], name: str) -> Callable[[], Column]:
        return lambda: F.when(F.col("j.type").isin(*kinds), F.col(f"j.payload.{name}"))

    usable = lambda: F.when(
        (F.col("j.type") == "event_msg") & (F.col("j.payload.type") == "token_count") & (F.col(f"{usage}.input_tokens") >= 0)
        & (F.col(f"{usage}.output_tokens") >= 0) & iso_to_ms(F.col("j.timestamp")).isNotNull(), F.lit(True))
    return _speaking(lines, _CODEX_SCHEMA, _CODEX_MARKERS, {
        "session": header(("session_meta",), "session_id"), "cwd": header(("session_meta", "turn_context"), "cwd"),
        "model": header(("session_meta", "turn_context"), "model"), "reading": usable})


def pi_speaks(lines: DataFrame) -> DataFrame:
    return _speaking(lines, "type string, cwd string", ['"type":"session"'], {
        "cwd": lambda: F.when(F.col("j.type") == "session", F.col("j.cwd"))})


def gemini_speaks(lines: DataFrame) -> DataFrame:
    return _speaking(lines, "sessionId string", ['"sessionId"'], {"session": lambda: F.col("j.sessionId")})


def codex_limits(lines: DataFrame) -> DataFrame:
    """Quota snapshots embedded in the token lines: agent, position, read_at_ms, plan, windows."""
    rows = _parsed(lines, _CODEX_SCHEMA, ["token_count"]).filter(
        (F.col("j.type") == "event_msg") & (F.col("j.payload.type") == "token_count"))

    def window(side: str, kind: str) -> Column:
        at = f"j.payload.rate_limits.{side}"
        return F.when(F.col(f"{at}.used_percent").isNotNull(), F.struct(
            F.lit(kind).alias("kind"), F.col(f"{at}.used_percent").alias("used_percent"),
            (F.coalesce(F.col(f"{at}.resets_at"), F.lit(0).cast("bigint")) * 1000).alias("resets_at_ms")))

    windows = F.array_compact(F.array(window("primary", "five_hour"), window("secondary", "weekly")))
    return rows.select(
        F.lit("codex").alias("agent"), "source_file", *ORDER,
        iso_to_ms(F.col("j.timestamp")).alias("read_at_ms"),
        F.col("j.payload.rate_limits.plan_type").alias("plan"), windows.alias("windows")
    ).filter(F.col("read_at_ms").isNotNull() & (F.size("windows") > 0))


def pi(lines: DataFrame, stage: Stage = as_is) -> DataFrame:
    rows = _parsed(lines, (
        "type string, id string, timestamp string, cwd string, message struct<role string, "
        "model string, usage struct<input bigint, output bigint, cacheRead bigint, cacheWrite bigint>>"),
        ['"role":"assistant"', '"type":"session"'])
    carried = _context(stage(rows), ctx_cwd=F.when(F.col("j.type") == "session", F.col("j.cwd")))
    kept = carried.filter(
        (F.col("j.type") == "message") & (F.col("j.message.role") == "assistant")
        & F.col("j.message.model").isNotNull() & F.col("j.message.usage").isNotNull())
    ts = iso_to_ms(F.col("j.timestamp"))
    usage = "j.message.usage"
    return _events(
        kept, "pi", ts_ms=ts, model=F.col("j.message.model"),
        input_tokens=count_of(F.col(f"{usage}.input")), output_tokens=count_of(F.col(f"{usage}.output")),
        cache_creation_tokens=count_of(F.col(f"{usage}.cacheWrite")),
        cache_read_tokens=count_of(F.col(f"{usage}.cacheRead")),
        session_id=F.substring_index(file_stem(F.col("source_file"), ".jsonl"), "_", -1),
        cwd=text_of(F.col("ctx_cwd")),
        dedup_key=F.concat(F.col("j.id"), F.lit(":"), ts.cast("string")))


def gemini(lines: DataFrame, stage: Stage = as_is) -> DataFrame:
    rows = _parsed(lines, (
        "sessionId string, id string, timestamp string, type string, model string, "
        "tokens struct<input bigint, output bigint, cached bigint, thoughts bigint>"),
        ['"tokens"', '"sessionId"'])
    carried = _context(stage(rows), ctx_session=F.col("j.sessionId"))
    kept = carried.filter(F.col("j.sessionId").isNull() & (F.col("j.type") == "gemini")
                          & F.col("j.tokens").isNotNull())
    stem = file_stem(F.col("source_file"), ".jsonl")
    named = F.when(stem.startswith("session-"), F.substring(stem, F.lit(9), F.length(stem))).otherwise(stem)
    session = _present(F.col("ctx_session"), named)
    cached = count_of(F.col("j.tokens.cached"))
    return _events(
        kept, "gemini", ts_ms=iso_to_ms(F.col("j.timestamp")), model=text_of(F.col("j.model")),
        input_tokens=F.greatest(count_of(F.col("j.tokens.input")) - cached, F.lit(0).cast("bigint")),
        output_tokens=count_of(F.col("j.tokens.output")) + count_of(F.col("j.tokens.thoughts")),
        cache_read_tokens=cached, session_id=session,
        dedup_key=F.concat(session, F.lit(":"), F.col("j.id")))


def qwen(lines: DataFrame) -> DataFrame:
    rows = _parsed(lines, (
        "uuid string, sessionId string, timestamp string, type string, cwd string, model string, "
        "usageMetadata struct<promptTokenCount bigint, candidatesTokenCount bigint, "
        "cachedContentTokenCount bigint, thoughtsTokenCount bigint>"), ['"usageMetadata"'])
    kept = rows.filter((F.col("j.type") == "assistant") & F.col("j.usageMetadata").isNotNull())
    usage = "j.usageMetadata"
    cached = count_of(F.col(f"{usage}.cachedContentTokenCount"))
    own = text_of(F.col("j.sessionId"))
    return _events(
        kept, "qwen", ts_ms=iso_to_ms(F.col("j.timestamp")), model=text_of(F.col("j.model")),
        input_tokens=F.greatest(count_of(F.col(f"{usage}.promptTokenCount")) - cached, F.lit(0).cast("bigint")),
        output_tokens=count_of(F.col(f"{usage}.candidatesTokenCount"))
        + count_of(F.col(f"{usage}.thoughtsTokenCount")),
        cache_read_tokens=cached,
        session_id=F.when(own != "", own).otherwise(file_stem(F.col("source_file"), ".jsonl")),
        cwd=text_of(F.col("j.cwd")), dedup_key=F.col("j.uuid"))


def kimi(lines: DataFrame) -> DataFrame:
    wire = lines.filter(file_name(F.col("source_file")) == "wire.jsonl")
    rows = _parsed(wire, (
        "timestamp double, message struct<type string, payload struct<message_id string, "
        "token_usage struct<input_other bigint, output bigint, input_cache_read bigint, "
        "input_cache_creation bigint>>>"), ['"StatusUpdate"'])
    usage = "j.message.payload.token_usage"
    kept = rows.filter(
        (F.col("j.message.type") == "StatusUpdate") & F.col(usage).isNotNull()
        & F.col("j.message.payload.message_id").isNotNull()
        & (F.col("j.timestamp") >= 0) & (F.col("j.timestamp") < 1e12))
    return _events(
        kept, "kimi", ts_ms=F.round(F.col("j.timestamp") * 1000.0).cast("bigint"), model=F.lit(""),
        input_tokens=count_of(F.col(f"{usage}.input_other")), output_tokens=count_of(F.col(f"{usage}.output")),
        cache_creation_tokens=count_of(F.col(f"{usage}.input_cache_creation")),
        cache_read_tokens=count_of(F.col(f"{usage}.input_cache_read")),
        session_id=parent_name(F.col("source_file")), dedup_key=F.col("j.message.payload.message_id"))
