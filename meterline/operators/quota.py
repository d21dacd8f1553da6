"""Quota readings: latest state, pace, time to the limit (J8, ST5-ST8, ST18, ST20).

Readings are rows (agent, kind, seq, read_at_ms, used_percent, resets_at_ms,
plan); `seq` is the order of arrival, unique per agent.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.operators.folds import CHUNK_ROWS, chunked_fold, resumed_fold
from meterline.operators.gauges import resample
from meterline.operators.scan import Running, chunk_of, ordered_scan
from meterline.session import settled

# Fixed values of the pace.
ALPHA = 0.4
MIN_PACE = 0.001
MAX_ETA_MIN = 7 * 24 * 60
HISTORY_PERIOD_MS, HISTORY_BUCKETS = 300_000, 72
STALE_AFTER_MS = 5 * 60_000
DANGER_PERCENT, DANGER_WALL_MS = 80.0, 45 * 60_000


def latest(snapshots: DataFrame, chunk: Column) -> DataFrame:
    """Newest snapshot per agent, ties to the later line; the plan is carried when missing.

    `snapshots(agent, seq, read_at_ms, plan, windows)`. A snapshot older than one
    already read is ignored, its plan included.
    """
    seen = ordered_scan(snapshots.filter(F.size("windows") > 0), ["agent"], ["seq"], chunk,
                        newest=Running("max", F.col("read_at_ms")))
    accepted = seen.filter(F.col("read_at_ms") == F.col("newest"))
    plan = F.max_by("plan", F.when(F.col("plan").isNotNull(), F.col("seq")))
    return accepted.groupBy("agent").agg(
        F.max_by("read_at_ms", "seq").alias("read_at_ms"),
        F.coalesce(plan, F.lit("")).alias("plan"),
        F.max_by("windows", "seq").alias("windows"))


def as_readings(snapshots: DataFrame) -> DataFrame:
    """One row per quota window of a snapshot."""
    others = [c for c in snapshots.columns if c != "windows"]
    return snapshots.select(*others, F.explode("windows").alias("w")).select(
        *others, "w.kind", "w.used_percent", "w.resets_at_ms")


def _slope(rise: Column, elapsed_ms: Column, known: Column) -> Column:
    """Percent per minute where two consecutive readings allow one: later in time and not falling."""
    return F.when(known & (elapsed_ms > 0) & (rise >= 0), rise / (elapsed_ms / 60_000.0))


def pace(readings: DataFrame, keys: list[str], chunk: Column) -> DataFrame:
    """Smoothed percent per minute per key, with the last reading.

    The weight of a slope is ALPHA * (1 - ALPHA)^(slopes after it), so the smoothed
    pace is a sum. Chunks of a key are summed apart in one pass; the slope across
    each border and the weights of whole chunks are added on one row per chunk.
    """
    keep = F.lit(1 - ALPHA)
    part = Window.partitionBy(*keys, "chunk_no").orderBy("seq")
    inside = readings.select(*keys, "seq", "read_at_ms", "used_percent", chunk.alias("chunk_no")).withColumn(
        "slope", _slope(F.col("used_percent") - F.lag("used_percent").over(part),
                        F.col("read_at_ms") - F.lag("read_at_ms").over(part),
                        F.lag("used_percent").over(part) >= 0))
    # Slopes after a row: all minus those so far. A frame that reaches forward would be quadratic.
    after = F.count("slope").over(Window.partitionBy(*keys, "chunk_no")) - F.count("slope").over(
        part.rowsBetween(Window.unboundedPreceding, 0))
    reading = F.struct("used_percent", "read_at_ms")
    per_chunk = inside.withColumn("after", after).groupBy(*keys, "chunk_no").agg(
        F.count("slope").alias("n"), F.coalesce(F.sum(
            F.lit(ALPHA) * F.col("slope") * F.pow(keep, F.col("after").cast("double"))), F.lit(0.0)).alias("own"),
        F.min_by(reading, "seq").alias("first"), F.max_by(reading, "seq").alias("last"))
    by_chunk = Window.partitionBy(*keys).orderBy("chunk_no")
    prev = F.lag("last").over(by_chunk)
    bordered = per_chunk.withColumn("border", _slope(
        F.col("first.used_percent") - prev["used_percent"], F.col("first.read_at_ms") - prev["read_at_ms"],
        prev["used_percent"] >= 0))
    steps = F.col("n") + F.col("border").isNotNull().cast("bigint")
    later = F.sum("steps").over(Window.partitionBy(*keys)) - F.sum("steps").over(
        by_chunk.rowsBetween(Window.unboundedPreceding, 0))
    weighed = bordered.withColumn("steps", steps).withColumn("later", later).withColumn("part_pace", (
        F.col("own") + F.coalesce(F.lit(ALPHA) * F.col("border") * F.pow(keep, F.col("n").cast("double")), F.lit(0.0))
    ) * F.pow(keep, F.col("later").cast("double")))
    return weighed.groupBy(*keys).agg(F.sum("part_pace").alias("pace"), F.max_by("last", "chunk_no").alias("r")).select(
        *keys, "pace", "r.used_percent", "r.read_at_ms")


def _step_pace(state: list[float], at: float, percent: float) -> list[float]:
    """(percent, at, pace) after one more reading."""
    before, since, smooth = state
    if before >= 0 and at > since and percent >= before:
        smooth = ALPHA * ((percent - before) / ((at - since) / 60_000.0)) + (1 - ALPHA) * smooth
    return [percent, at, smooth]


def _pace_summary(rows: pd.DataFrame) -> dict:
    at, percent = rows["read_at_ms"].to_numpy(), rows["used_percent"].to_numpy()
    state, slopes = [percent[0], at[0], 0.0], 0
    for t, p in zip(at[1:], percent[1:]):
        slopes += bool(state[0] >= 0 and t > state[1] and p >= state[0])
        state = _step_pace(state, t, p)
    return {"first": [int(at[0]), float(percent[0])], "last": [float(percent[-1]), int(at[-1])],
            "keep": (1 - ALPHA) ** slopes, "add": float(state[2])}


def _advance_pace(state: list[float], s: dict) -> list[float]:
    smooth = _step_pace(state, *s["first"])[2]
    return [*s["last"], s["keep"] * smooth + s["add"]]


def _replay_pace(rows: pd.DataFrame, state: list[float]) -> pd.DataFrame:
    paces = []
    for t, p in zip(rows["read_at_ms"], rows["used_percent"]):
        state = _step_pace(state, t, p)
        paces.append(state[2])
    return rows.drop(columns=["chunk_no"]).assign(pace=paces)


_NO_PACE = [-1.0, 0, 0.0]


def _pace_rows(readings: DataFrame, keys: list[str]) -> tuple[DataFrame, str]:
    key_schema = ", ".join(f"{k} {readings.schema[k].dataType.simpleString()}" for k in keys)
    return (readings.select(*keys, "seq", "read_at_ms", "used_percent"),
            f"{key_schema}, seq bigint, read_at_ms bigint, used_percent double, pace double")


def running_pace(readings: DataFrame, keys: list[str]) -> DataFrame:
    """The pace after every reading. A chunk maps the incoming pace affinely, so it is a few numbers."""
    rows, schema = _pace_rows(readings, keys)
    return chunked_fold(rows, keys, ["seq"], chunk_of(F.col("seq"), CHUNK_ROWS), _NO_PACE, _pace_summary, _advance_pace,
                        _replay_pace, schema)


def resumed_pace(readings: DataFrame, keys: list[str], known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pace after every new reading, going on from the `known` states of earlier ones (keys, state); and the states after them."""
    rows, schema = _pace_rows(readings, keys)
    return resumed_fold(rows, keys, ["seq"], chunk_of(F.col("seq"), CHUNK_ROWS), known, _NO_PACE, _pace_summary, _advance_pace,
                        _replay_pace, schema)


def observed_walls(paced: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """The nearest projected wall at every observation of a host, null when none is in sight.

    `paced` is `running_pace` per (host, agent, kind). Each of the `keys` - a closed
    set of (agent, kind) - keeps its last reading, and projects from it at the
    instant of every later observation of any key.
    """
    chunk = chunk_of(F.col("seq"), CHUNK_ROWS)
    paced = settled(paced)
    outputs = {}
    for i, (agent, kind) in enumerate(keys):
        own = (F.col("agent") == agent) & (F.col("kind") == kind)
        outputs[f"k{i}"] = Running("last", F.when(own, F.struct("used_percent", "pace")))
    known = ordered_scan(paced.withColumn("now_ms", F.col("read_at_ms")), ["host"], ["seq"], chunk, **outputs)
    candidates = []
    for i, (agent, kind) in enumerate(keys):
        at = eta_ms(F.col("now_ms"), F.col(f"k{i}.used_percent"), F.col(f"k{i}.pace"))
        candidates.append(F.when(at.isNotNull(), F.struct(
            at.alias("wall_at_ms"), F.lit(i).alias("rank"), F.lit(agent).alias("agent"), F.lit(kind).alias("kind"),
            F.col(f"k{i}.used_percent").alias("used_percent"))))
    nearest = F.array_min(F.array(*candidates))
    return known.select("host", "seq", "now_ms", nearest.alias("w")).select(
        "host", "seq", "now_ms", "w.agent", "w.kind", "w.used_percent", "w.wall_at_ms")


def eta_ms(now_ms: Column, used_percent: Column, pace_per_min: Column) -> Column:
    """Instant a window reaches 100 %; null without a pace or beyond a week, `now` when full."""
    minutes = (F.lit(100.0) - used_percent) / pace_per_min
    return (F.when((used_percent < 0) | (pace_per_min < MIN_PACE), F.lit(None).cast("bigint"))
            .when(used_percent >= 100, now_ms)
            .when(minutes > MAX_ETA_MIN, F.lit(None).cast("bigint"))
            .otherwise(now_ms + (minutes * 60_000.0).cast("bigint")))


def walls(paces: DataFrame, now_ms: int) -> DataFrame:
    return paces.withColumn("wall_at_ms", eta_ms(F.lit(now_ms).cast("bigint"), F.col("used_percent"),
                                                 F.col("pace")))


def nearest_wall(walled: DataFrame, keys: list[str]) -> DataFrame:
    """The earliest projected wall over all windows, ties by key; no row when there is none."""
    hit = walled.filter(F.col("wall_at_ms").isNotNull())
    return hit.orderBy("wall_at_ms", *keys).limit(1).select(*keys, "wall_at_ms", "used_percent")


def max_utilisation(walled: DataFrame, keys: list[str]) -> DataFrame:
    return walled.filter(F.col("used_percent") >= 0).orderBy(F.desc("used_percent"), *keys).limit(1).select(
        *keys, "used_percent")


def danger(walled: DataFrame, now_ms: int) -> DataFrame:
    """Any window past 80 %, or a wall less than 45 minutes away."""
    return walled.agg(F.coalesce(
        F.max((F.col("used_percent") > DANGER_PERCENT)
              | F.coalesce(F.col("wall_at_ms") - now_ms < DANGER_WALL_MS, F.lit(False))),
        F.lit(False)).alias("danger"))


def utilisation_history(readings: DataFrame, keys: list[str], now_ms: int) -> DataFrame:
    """Last reading per 5 minutes over 6 hours, gaps null."""
    samples = readings.select(*keys, "seq", F.col("read_at_ms").alias("ts_ms"),
                              F.col("used_percent").alias("value"))
    return resample(samples, keys, now_ms, HISTORY_PERIOD_MS, HISTORY_BUCKETS, order=("seq",))


def staleness(readings: DataFrame, now_ms: int) -> DataFrame:
    """Per agent: newest reading, minutes since once older than 5 minutes, soonest future reset."""
    return readings.groupBy("agent").agg(
        F.max("read_at_ms").alias("read_at_ms"),
        F.min(F.when(F.col("resets_at_ms") > now_ms, F.col("resets_at_ms"))).alias("next_reset_ms")
    ).withColumn("stale_min", F.when(F.lit(now_ms) - F.col("read_at_ms") > STALE_AFTER_MS, F.floor(
        (F.lit(now_ms) - F.col("read_at_ms")) / 60_000).cast("bigint")))
