"""Threshold, wall and reset alerts with hysteresis and a rate limit (J6, ST14-ST17, ST19).

Observations are readings (host, seq, now_ms, agent, kind, used_percent,
resets_at_ms), one per (host, seq, agent, kind); walls are one row per (host, seq) at most.
The latches are Schmitt triggers: the state is the last decisive reading, which
is a scan. Only the high-water mark of resets and the rate limit step a state, both over bounded chunks.
An observation (host, seq) may hold the readings of several windows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.functions.money import clamp
from meterline.operators.folds import CHUNK_ROWS, chunked_fold, resumed_fold
from meterline.operators.scan import Running, chunk_of, ordered_scan, union_all
from meterline.session import settled

# Fixed values of the alert rules.
WALL_FIRE_MS, WALL_REARM_MS = 30 * 60_000, 45 * 60_000
REARM_DROP = 5.0
RESET_FLOOR, RESET_DROP = 70.0, 30.0
RATE_LIMIT_MS = 10 * 60_000
MAX_PER_OBSERVATION = 3
FIRST_FIRE_FLOOR = 90
WALL_PRIORITY, RESET_PRIORITY, THRESHOLD_BASE = 300, 0, 100
DEFAULT_THRESHOLDS = (70, 90)

CANDIDATE = ("host", "seq", "now_ms", "agent", "kind", "alert", "priority", "threshold", "percent",
             "prev_high", "resets_at_ms", "wall_at_ms")
READING = ("host", "seq", "now_ms", "agent", "kind", "used_percent", "resets_at_ms")
WALL = ("host", "seq", "now_ms", "agent", "kind", "used_percent", "wall_at_ms")
_CANDIDATE_TYPES = {"host": "bigint", "seq": "bigint", "now_ms": "bigint", "agent": "string",
                    "kind": "string", "alert": "string", "priority": "int", "threshold": "int",
                    "percent": "double", "prev_high": "double", "resets_at_ms": "bigint",
                    "wall_at_ms": "bigint"}
_SCHEMA = ", ".join(f"{c} {_CANDIDATE_TYPES[c]}" for c in CANDIDATE)


def _shaped(df: DataFrame, **values) -> DataFrame:
    return df.select(*[(values[c] if c in values else
                        (F.col(c) if c in df.columns else F.lit(None))).cast(_CANDIDATE_TYPES[c]).alias(c)
                       for c in CANDIDATE])


def threshold_candidates(observations: DataFrame, thresholds: tuple[int, ...] = DEFAULT_THRESHOLDS) -> DataFrame:
    """Upward crossings per (agent, window): the highest tier that was not latched.

    A tier latches at its value and re-arms 5 points below it. The first reading
    of a window latches what it has crossed and fires only tiers of 90 and above.
    """
    pct = clamp(F.col("used_percent"), 0.0, 100.0)
    readings = observations.withColumn("percent", pct)
    decisive = {t: F.when(F.col("percent") >= t, True).when(F.col("percent") <= t - REARM_DROP, False)
                for t in thresholds}
    scanned = ordered_scan(
        readings, ["host", "agent", "kind"], ["seq"], chunk_of(F.col("seq"), CHUNK_ROWS),
        before=Running("lag", F.col("percent")),
        **{f"latched_{t}": Running("last_before", decisive[t]) for t in thresholds})
    fires = [F.when((F.col("percent") >= t) & ~F.coalesce(F.col(f"latched_{t}"), F.lit(False))
                    & (F.col("before").isNotNull() | F.lit(t >= FIRST_FIRE_FLOOR)), F.lit(t))
             for t in thresholds]
    highest = F.greatest(*fires) if len(fires) > 1 else fires[0]
    hit = scanned.withColumn("threshold", highest).filter(F.col("threshold").isNotNull())
    return _shaped(hit, alert=F.lit("threshold"), priority=F.col("threshold") + THRESHOLD_BASE)


def wall_candidates(walls: DataFrame) -> DataFrame:
    """A wall at most 30 minutes away; re-armed beyond 45 minutes or without a wall.

    `walls` has a row for every observation, with null where no wall is in sight.
    """
    away = F.col("wall_at_ms") - F.col("now_ms")
    near = F.when(away <= WALL_FIRE_MS, True).when(F.col("wall_at_ms").isNull() | (away > WALL_REARM_MS), False)
    scanned = ordered_scan(walls.withColumn("near", near), ["host"], ["seq"],
                           chunk_of(F.col("seq"), CHUNK_ROWS), latched=Running("last_before", F.col("near")))
    hit = scanned.filter(F.col("near") & ~F.coalesce(F.col("latched"), F.lit(False)))
    return _shaped(hit, alert=F.lit("wall_imminent"), priority=F.lit(WALL_PRIORITY),
                   percent=F.col("used_percent"))


def _first_reset(percent: np.ndarray, start: int, high: float) -> tuple[int, float]:
    """Index of the first reset at or after `start` with a high-water mark, and the mark it falls from."""
    size = 64
    while start < len(percent):
        block = percent[start:start + size]
        marks = np.maximum.accumulate(np.concatenate(([high], block)))
        hits = np.flatnonzero((marks[:-1] >= RESET_FLOOR) & (block <= marks[:-1] - RESET_DROP))
        if len(hits):
            return start + int(hits[0]), float(marks[hits[0]])
        start, high, size = start + size, marks[-1], size * 2
    return -1, float("nan")


def _mark_after(percent: np.ndarray, at: int, memo: dict[int, float]) -> float:
    """High-water mark at the end of a chunk when a reset fires at `at`."""
    path = []
    while at not in memo:
        path.append(at)
        following, _ = _first_reset(percent, at + 1, percent[at])
        if following < 0:
            memo[at] = float(percent[at:].max())
            break
        at = following
    for step in path:
        memo[step] = memo[at]
    return memo[at]


def _reset_summary(rows: pd.DataFrame) -> dict:
    """What a chunk does to any incoming mark: `steps` of (mark from which it applies, mark after)."""
    percent = rows["percent"].to_numpy()
    memo: dict[int, float] = {}
    own, _ = _first_reset(percent, 1, percent[0]) if len(percent) > 1 else (-1, 0.0)
    reach = percent if own < 0 else percent[:own]
    # Only a new low can be the first reset of a higher incoming mark.
    lows = np.flatnonzero(reach < np.concatenate(([np.inf], np.minimum.accumulate(reach)[:-1])))
    steps = [[max(RESET_FLOOR, float(reach[i]) + RESET_DROP), _mark_after(percent, int(i), memo)]
             for i in lows]
    return {"steps": steps, "own": None if own < 0 else _mark_after(percent, own, memo),
            "high": float(percent.max())}


def _advance_mark(mark: float, summary: dict) -> float:
    for needed, after in summary["steps"]:
        if mark >= needed:
            return after
    return summary["own"] if summary["own"] is not None else max(mark, summary["high"])


def _replay_resets(rows: pd.DataFrame, mark: float) -> pd.DataFrame:
    percent = rows["percent"].to_numpy()
    at, highs, hits = 0, [], []
    while at < len(percent):
        found, high = _first_reset(percent, at, mark)
        if found < 0:
            break
        hits.append(found)
        highs.append(high)
        at, mark = found + 1, percent[found]
    return rows.iloc[hits].assign(prev_high=highs)[
        ["host", "seq", "now_ms", "agent", "kind", "percent", "prev_high"]]


_RESETS = "host bigint, seq bigint, now_ms bigint, agent string, kind string, percent double, prev_high double"
_WINDOW = ["host", "agent", "kind"]


def _percents(observations: DataFrame) -> DataFrame:
    return observations.select("host", "seq", "now_ms", "agent", "kind", clamp(F.col("used_percent"), 0.0, 100.0).alias("percent"))


def _resets(fired: DataFrame) -> DataFrame:
    return _shaped(fired, alert=F.lit("window_reset"), priority=F.lit(RESET_PRIORITY))


def reset_candidates(observations: DataFrame) -> DataFrame:
    """A window that had reached 70 % falls 30 points or more; the mark restarts there."""
    return _resets(chunked_fold(
        _percents(observations), _WINDOW, ["seq"], chunk_of(F.col("seq"), CHUNK_ROWS), -1.0,
        _reset_summary, _advance_mark, _replay_resets, _RESETS))


def resumed_resets(observations: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`reset_candidates` that go on from the marks of earlier readings (host, agent, kind, state), and the marks after them."""
    fired, marks = resumed_fold(
        _percents(observations), _WINDOW, ["seq"], chunk_of(F.col("seq"), CHUNK_ROWS), known, -1.0,
        _reset_summary, _advance_mark, _replay_resets, _RESETS)
    return _resets(fired), marks


def limited(rows: pd.DataFrame, fired: dict[str, int]) -> tuple[np.ndarray, dict[str, int]]:
    """Which candidates go out, in the order given, when `fired` says what went out last before; and what went out last in them."""
    goes, own, seq, sent = np.zeros(len(rows), bool), {}, None, 0
    last = dict(fired)
    slots = (rows["agent"] + "/" + rows["alert"]).tolist()
    for n, (slot, at, now) in enumerate(zip(slots, rows["seq"].tolist(), rows["now_ms"].tolist(), strict=True)):
        if at != seq:
            seq, sent = at, 0
        if sent < MAX_PER_OBSERVATION and (slot not in last or now - last[slot] >= RATE_LIMIT_MS):
            goes[n], last[slot], own[slot], sent = True, now, now, sent + 1
    return goes, own


_PART = "host bigint, chunk_no bigint"
LIMITS = "host bigint, state string"


def _carried(states: DataFrame, known: DataFrame | None) -> DataFrame:
    """Per chunk what went out last before it, as far as it can matter there, and after it: one small row per chunk, streamed."""
    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, {}
        for batch in batches:
            incoming, after = [], []
            for host, low, fires, start in zip(batch["host"], batch["low"], batch["fires"], batch["start"], strict=True):
                if host != current:
                    current, last = host, {} if start is None else json.loads(start)
                incoming.append(json.dumps({s: t for s, t in sorted(last.items()) if low - t < RATE_LIMIT_MS}))
                last |= json.loads(fires)
                after.append(json.dumps(last))
            yield batch[["host", "chunk_no", "used"]].assign(incoming=incoming, after=after)

    if known is None:
        states = states.withColumn("start", F.lit(None).cast("string"))
    else:
        states = states.join(known.select("host", F.col("state").alias("start")), "host", "left")
    return states.select("host", "chunk_no", "low", "used", "fires", "start").repartition("host").sortWithinPartitions(
        "host", "chunk_no").mapInPandas(carry, f"{_PART}, used string, incoming string, after string")


def delivered(candidates: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Candidates that go out: by priority, at most 3 per observation and one per
    (agent, alert) in 10 minutes. What is held back is dropped, never queued.

    What a chunk of observations lets through depends on what went out before it. All chunks run at once as if nothing had; then
    every chunk that was wrong about that, as far as its own clock reaches back, runs again with what its
    predecessors say now, until none was wrong. The first wrong chunk of a host is right after its next run, so this ends; after a
    quiet gap, or a chunk that ends as it did before, nothing runs again.
    """
    return _delivered(candidates, None, chunk_rows)[0]


def resumed_delivery(candidates: DataFrame, known: DataFrame, chunk_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """`delivered` that goes on from what went out last (host, state), and the states after it."""
    out, carried = _delivered(candidates, known, chunk_rows)
    after = carried.groupBy("host").agg(F.max_by("after", "chunk_no").alias("state"))
    return out, after.unionByName(known.select("host", "state").join(after.select("host"), "host", "left_anti"))


def _delivered(candidates: DataFrame, known: DataFrame | None, chunk_rows: int | None) -> tuple[DataFrame, DataFrame]:
    rows_per_chunk = chunk_rows or CHUNK_ROWS
    # Few rows, read by every round: computed once.
    ordered = settled(_shaped(candidates).withColumns({
        "rank": -F.col("priority"), "chunk_no": chunk_of(F.col("seq"), rows_per_chunk)}))
    order = ["seq", "rank", "agent", "kind", "alert"]
    names = [*CANDIDATE, "chunk_no", "low", "used", "fires"]
    both = f"{_SCHEMA}, chunk_no bigint, low bigint, used string, fires string"

    def run(rows: pd.DataFrame, incoming: dict) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        goes, own = limited(rows, incoming)
        state = pd.DataFrame([{
            "host": rows["host"].iloc[0], "chunk_no": rows["chunk_no"].iloc[0], "low": int(rows["now_ms"].min()),
            "used": json.dumps(dict(sorted(incoming.items()))), "fires": json.dumps(own)}])
        kinds = {"threshold": "Int32", "priority": "Int32", **{c: "Int64" for c in ("seq", "now_ms", "resets_at_ms", "wall_at_ms", "low")},
                 **{c: object for c in ("agent", "kind", "alert", "used", "fires")}}
        return pd.concat([frame.reindex(columns=names).astype(kinds) for frame in (state, rows[goes]) if len(frame)])

    def rerun(rows: pd.DataFrame, wrong: pd.DataFrame) -> pd.DataFrame:
        return run(rows, json.loads(wrong["incoming"].iloc[0])) if len(wrong) else pd.DataFrame(columns=names)

    results = settled(ordered.groupBy("host", "chunk_no").applyInPandas(lambda rows: run(rows, {}), both))
    while True:
        carried = settled(_carried(results.filter("fires IS NOT NULL"), known))
        wrong = carried.filter(F.col("used") != F.col("incoming")).select("host", "chunk_no", "incoming")
        if wrong.isEmpty():
            return results.filter("fires IS NULL").select(*CANDIDATE), carried
        again = ordered.groupBy("host", "chunk_no").cogroup(wrong.groupBy("host", "chunk_no")).applyInPandas(rerun, both)
        # A chunk's last run counts, its state as well as what it lets through.
        results = settled(results.join(wrong, ["host", "chunk_no"], "left_anti").unionByName(again))


def speaking(readings: DataFrame, thresholds: tuple[int, ...] = DEFAULT_THRESHOLDS) -> DataFrame:
    """The readings that speak for later ones, a few per (host, agent, kind): the last, and the last that decided each tier."""
    pct = clamp(F.col("used_percent"), 0.0, 100.0)
    row = F.struct(*READING)
    decisive = [F.max_by(row, F.when((pct >= t) | (pct <= t - REARM_DROP), F.col("seq"))) for t in thresholds]
    last = readings.groupBy("host", "agent", "kind").agg(F.array_distinct(F.array_compact(F.array(F.max_by(row, "seq"), *decisive))).alias("r"))
    return last.select(F.explode("r").alias("r")).select("r.*")


def speaking_walls(walls: DataFrame) -> DataFrame:
    """The last row of each host that decided the latch of walls."""
    away = F.col("wall_at_ms") - F.col("now_ms")
    decisive = F.col("wall_at_ms").isNull() | (away <= WALL_FIRE_MS) | (away > WALL_REARM_MS)
    return walls.filter(decisive).groupBy("host").agg(F.max_by(F.struct(*WALL), "seq").alias("r")).select("r.*")


def alerts(observations: DataFrame, walls: DataFrame | None = None,
           thresholds: tuple[int, ...] = DEFAULT_THRESHOLDS) -> DataFrame:
    """All delivered alerts of all hosts."""
    parts = [threshold_candidates(observations, thresholds), reset_candidates(observations)]
    if walls is not None:
        parts.append(wall_candidates(walls))
    return delivered(union_all(parts))


def with_wall(fired: DataFrame, walls: DataFrame) -> DataFrame:
    """Threshold alerts next to the projected wall of the same window, for the message body."""
    known = walls.filter(F.col("wall_at_ms").isNotNull()).select(
        "host", "seq", "agent", "kind", F.col("wall_at_ms").alias("projected_wall_ms"))
    return fired.join(known, ["host", "seq", "agent", "kind"], "left")


def pending(fired: DataFrame, acknowledged_ms: int) -> DataFrame:
    """Newest alert per host, and whether it is newer than the acknowledgement."""
    return fired.groupBy("host").agg(F.max("now_ms").alias("newest_ms")).withColumn(
        "pending", F.col("newest_ms") > acknowledged_ms)
