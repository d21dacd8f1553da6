"""All sources as one ingest (SRC17, SRC18, U1, U2)."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.operators.scan import union_all
from meterline.schemas import agents
from meterline.session import settled
from meterline.sources import ledgers, lines, snapshots, transcripts


@dataclass(frozen=True)
class SourceSpec:
    """A source: how to read its paths, and how rows become events (append-only) or versions (rewritten).

    For repeated sweeps a log has `parse`, and `speaks` if some of its lines speak for later ones; a ledger has `since`.
    """

    agent: str
    kind: str
    read: Callable[[SparkSession, str | list[str]], DataFrame]
    parse: Callable[[DataFrame], DataFrame] | None = None
    glob: str = ""
    speaks: Callable[[DataFrame], DataFrame] | None = None
    since: Callable[[SparkSession, str, DataFrame], tuple[DataFrame, DataFrame]] | None = None


def _log(agent: str, parse: Callable[[DataFrame], DataFrame], glob: str = "*.jsonl",
         speaks: Callable[[DataFrame], DataFrame] | None = None) -> SourceSpec:
    return SourceSpec(agent, "events", lambda spark, paths: parse(lines.read_log(spark, paths, glob)), parse, glob, speaks)


def _headed(agent: str, parse: Callable[[DataFrame, transcripts.Stage], DataFrame],
            speaks: Callable[[DataFrame], DataFrame]) -> SourceSpec:
    """A log whose header lines speak for later lines: its parsed rows are written before they are scanned."""
    return _log(agent, lambda log: parse(log, settled), speaks=speaks)


def _ledger(agent: str, read: Callable[[SparkSession, str], DataFrame],
            since: Callable[[SparkSession, str, DataFrame], tuple[DataFrame, DataFrame]]) -> SourceSpec:
    return SourceSpec(agent, "events", read, since=since)


SOURCES: dict[str, SourceSpec] = {s.agent: s for s in [
    _log("claude", transcripts.claude),
    _headed("codex", transcripts.codex, transcripts.codex_speaks),
    _headed("pi", transcripts.pi, transcripts.pi_speaks),
    _headed("gemini", transcripts.gemini, transcripts.gemini_speaks),
    _log("qwen", transcripts.qwen),
    _log("kimi", transcripts.kimi, "wire.jsonl"),
    _ledger("goose", lambda spark, path: ledgers.goose(ledgers.goose_rows(spark, path)), ledgers.goose_since),
    _ledger("kilo", lambda spark, path: ledgers.kilo(*ledgers.kilo_rows(spark, path)), ledgers.kilo_since),
    SourceSpec("opencode", "versions", lambda spark, path: ledgers.opencode(*ledgers.opencode_rows(spark, path))),
    SourceSpec("cline", "versions", lambda spark, paths: snapshots.cline_messages(
        lines.whole_files(spark, paths, "*.messages.json")).unionByName(snapshots.task_messages(
            lines.whole_files(spark, paths, "ui_messages.json"), "cline"))),
    SourceSpec("roo", "versions", lambda spark, paths: snapshots.task_messages(
        lines.whole_files(spark, paths, "ui_messages.json"), "roo")),
]}


def problem_of(problem: Exception) -> str:
    """One line that says what failed; of a failure inside Python code of a task or a reader also its own error."""
    lines_ = str(problem).splitlines() or [""]
    said = lines_[0] if isinstance(problem, PySparkException) else f"{type(problem).__name__}: {lines_[0]}"
    inner = [x.strip() for x in lines_[1:] if re.match(r"[\w.]+(Error|Exception)\b", x)]
    return f"{said} {inner[-1]}" if inner else said


def sweep(spark: SparkSession, paths: dict[str, str | list[str]], enabled: list[str],
          kind: str = "events") -> tuple[DataFrame | None, DataFrame]:
    """Events (or versions) of the enabled sources as one frame, and one status row per source.

    Each source is read to its end inside its own `try`: one that fails, while planning or while running, is
    reported and left out; the others go on. So does a name that no source has.
    """
    frames, status = [], []
    for agent in [*SOURCES, *sorted(set(enabled) - set(SOURCES))]:
        if agent not in enabled or agent not in paths or (agent in SOURCES and SOURCES[agent].kind != kind):
            continue
        try:
            frames.append(settled(SOURCES[agent].read(spark, paths[agent])))
            status.append((agent, True, ""))
        except Exception as problem:  # noqa: BLE001 - whatever it is, it is this source's
            status.append((agent, False, problem_of(problem)))
    report = spark.createDataFrame(status, "agent string, ok boolean, problem string")
    return (union_all(frames) if frames else None), report


def added_sources(now_enabled: DataFrame, before: DataFrame) -> DataFrame:
    """Sources a reload switched on: the ones to backfill."""
    return now_enabled.select("agent").distinct().join(before.select("agent"), "agent", "left_anti")


def coverage(hour_cells: DataFrame, enabled: list[str], detected: dict[str, bool]) -> DataFrame:
    """Per agent: enabled, detected (null without a collector), events, first and last hour seen."""
    spark = hour_cells.sparkSession
    seen = hour_cells.groupBy("agent").agg(
        F.sum("events").cast("bigint").alias("events"), (F.min("bucket") * 3_600_000).alias("first_seen_ms"),
        (F.max("bucket") * 3_600_000).alias("last_seen_ms"))
    found = F.create_map(*[F.lit(x) for pair in detected.items() for x in pair]) if detected else None
    hit = found[F.col("agent")] if found is not None else F.lit(None).cast("boolean")
    return agents(spark).join(seen, "agent", "left").select(
        "agent", F.col("agent").isin(enabled).alias("enabled"),
        F.when(F.col("has_collector"), F.coalesce(hit, F.lit(False))).alias("detected"),
        F.coalesce("events", F.lit(0).cast("bigint")).alias("events"), "first_seen_ms", "last_seen_ms")
