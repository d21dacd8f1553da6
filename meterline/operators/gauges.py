"""Telemetry gauges and counters (R11-R19, ST8, ST22).

Samples come as a long table (host, metric, ts_ms, value). A window of `n`
periods per series is bounded by its arguments, so plain windows run on it;
scans over a whole history use chunked scans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.functions import timecols
from meterline.functions.money import clamp
from meterline.operators.scan import Running, chunk_of, dense, ordered_scan
from meterline.session import settled

GAUGE_PERIOD_MS, GAUGE_BUCKETS = 5_000, 360
# Time range of one chunk of a scan: short, so that the busiest series still splits into many tasks.
CHUNK_MS = 5 * 60_000
# Fixed values of the meters.
PEAK_DECAY_PER_SECOND = 0.9974968671630002
PEAK_DECAY_PER_SWEEP = 0.99923
NET_FLOOR_BPS, DISK_FLOOR_BPS = 1_000_000.0, 10_000_000.0
TICK_WRAP = 4294967296


def enabled_metrics(samples: DataFrame, metrics: list[str]) -> DataFrame:
    """Samples of the enabled modules; a masked module simply leaves gaps."""
    return samples.filter(F.col("metric").isin(metrics))


def resample(samples: DataFrame, keys: list[str], now_ms: int, period_ms: int = GAUGE_PERIOD_MS,
             buckets: int = GAUGE_BUCKETS, order: tuple[str, ...] = ("ts_ms",)) -> DataFrame:
    """Last value per period over the window ending at `now`; a gap is null."""
    newest = now_ms // period_ms
    bucket = timecols.floor_div(F.col("ts_ms"), period_ms)
    live = samples.withColumn("bucket", bucket).filter(
        F.col("bucket").between(newest - buckets + 1, newest))
    per_bucket = live.groupBy(*keys, "bucket").agg(F.max_by("value", F.struct(*order)).alias("value"))
    return dense(per_bucket, samples.select(*keys).distinct(), "bucket", newest - buckets + 1, newest)


def peak_downsample(frame: DataFrame, keys: list[str], buckets: int, newest: int, stride: int = 4) -> DataFrame:
    """Peak of every `stride` buckets, anchored on the newest; a remainder falls off the oldest end."""
    points = buckets // stride
    index = F.lit(points - 1) - F.floor((F.lit(newest) - F.col("bucket")) / F.lit(stride))
    return (frame.withColumn("point", index.cast("bigint")).filter(F.col("point") >= 0)
            .groupBy(*keys, "point").agg(F.max("value").alias("peak")))


def envelope(frame: DataFrame, keys: list[str], per_cell: int = 2) -> DataFrame:
    """Low and high percentage per cell of `per_cell` periods; an empty cell holds the last sample."""
    pct = clamp(F.col("value"), 0.0, 1.0) * 100
    pct = F.when(F.col("value").isNotNull(), pct)
    cells = frame.withColumn("cell", timecols.floor_div(F.col("bucket"), per_cell)).groupBy(*keys, "cell").agg(
        F.min(pct).alias("low"), F.max(pct).alias("high"),
        F.max_by(pct, F.when(F.col("value").isNotNull(), F.col("bucket"))).alias("latest"))
    held = F.coalesce(F.last("latest", ignorenulls=True).over(
        Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    return cells.withColumn("held", held).select(
        *keys, "cell", F.coalesce("low", "held").alias("low"), F.coalesce("high", "held").alias("high"))


def held_series(frame: DataFrame, keys: list[str], scaling: str = "fraction") -> DataFrame:
    """Last observation carried forward, null before the first; an all-null series has no rows."""
    scaled = clamp(F.col("value"), 0.0, 1.0) * 100 if scaling == "fraction" else F.greatest(
        F.col("value"), F.lit(0.0))
    value = F.when(F.col("value").isNotNull(), scaled)
    upto = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    return (frame.withColumn("any", F.max(F.col("value").isNotNull()).over(whole)).filter("any")
            .withColumn("value", F.last(value, ignorenulls=True).over(upto)).drop("any"))


def combined_share_of_peak(rx: DataFrame, tx: DataFrame, keys: list[str]) -> DataFrame:
    """(rx + tx) as a percentage of its own peak in the window."""
    both = rx.withColumnRenamed("value", "rx").join(
        tx.withColumnRenamed("value", "tx"), [*keys, "bucket"]).withColumn("total", F.col("rx") + F.col("tx"))
    peak = F.max("total").over(Window.partitionBy(*keys))
    return both.withColumn("peak", peak).select(
        *keys, "bucket", F.when(F.col("peak") > 0, F.col("total") / F.col("peak") * 100)
        .otherwise(F.col("total")).alias("value"))


def sqrt_scaled(value: Column) -> Column:
    return F.sqrt(value.cast("double"))


def needle(tokens: Column, period_ms: int, scale_tpm: float) -> Column:
    """Tokens of one period as a percentage of the dial."""
    return clamp(tokens * (60_000.0 / period_ms) / max(scale_tpm, 1.0) * 100, 0.0, 100.0)


def counter_rates(counters: DataFrame, keys: list[str], order: tuple[str, ...] = ("ts_ms", "seq"),
                  chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Per-second rate of a growing counter: null at first, 0 when it fell or no time passed."""
    stepped = ordered_scan(counters, keys, list(order), chunk_of(F.col("ts_ms"), chunk_ms),
                           prev=Running("lag", F.struct("ts_ms", "value")))
    elapsed = F.col("ts_ms") - F.col("prev.ts_ms")
    grown = F.greatest(F.col("value") - F.col("prev.value"), F.lit(0).cast("bigint"))
    rate = F.when(F.col("prev").isNull(), F.lit(None).cast("double")).when(
        elapsed <= 0, F.lit(0.0)).otherwise(grown * 1000.0 / elapsed)
    return stepped.withColumn("rate", rate).drop("prev")


def busy_fraction(ticks: DataFrame, keys: list[str], groups: tuple[str, ...] = (),
                  chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Busy share of a group of cores from u32 tick counters.

    `ticks(host.., core, ts_ms, busy, idle, cores)`. Counters may wrap once; a
    changed core count starts a new baseline.
    """
    stepped = ordered_scan(ticks, [*keys, "core"], ["ts_ms"], chunk_of(F.col("ts_ms"), chunk_ms),
                           prev=Running("lag", F.struct("busy", "idle", "cores")))
    usable = stepped.filter(F.col("prev").isNotNull() & (F.col("prev.cores") == F.col("cores")))
    wrap = F.lit(TICK_WRAP)
    moved = usable.withColumns({
        "d_busy": F.pmod(F.col("busy") - F.col("prev.busy"), wrap),
        "d_idle": F.pmod(F.col("idle") - F.col("prev.idle"), wrap)})
    summed = moved.groupBy(*keys, *groups, "ts_ms").agg(
        F.sum("d_busy").alias("b"), F.sum("d_idle").alias("i"))
    total = F.col("b") + F.col("i")
    return summed.select(*keys, *groups, "ts_ms",
                         F.when(total == 0, F.lit(0.0)).otherwise(F.col("b") / total).alias("busy_fraction"))


def ratcheted_peak(samples: DataFrame, keys: list[str], floor: float, origin_ms: int = 0,
                   chunk_ms: int = CHUNK_MS, order: tuple[str, ...] = ("ts_ms",)) -> DataFrame:
    """Peak that jumps up at once and decays by the second, and the value as a share of it.

    peak_i = max over j <= i of max(v_j, floor) * d^(t_i - t_j): in logarithms a
    running maximum, so no fold is needed.
    """
    log_decay = math.log(PEAK_DECAY_PER_SECOND)
    seconds = (F.col("ts_ms") - F.lit(origin_ms)) / 1000.0
    level = F.ln(F.greatest(F.col("value"), F.lit(floor))) - seconds * log_decay
    scanned = ordered_scan(samples, keys, list(order), chunk_of(F.col("ts_ms"), chunk_ms),
                           level=Running("max", level))
    peak = F.exp(F.col("level") + seconds * log_decay)
    return scanned.withColumn("peak", peak).withColumn(
        "meter", F.when(F.col("peak") <= 0, F.lit(0.0)).otherwise(
            clamp(F.col("value") / F.col("peak"), 0.0, 1.0))).drop("level")


def dial_scale(peak: Column) -> Column:
    """Smallest 1-2-5 step that clears the peak by 15 %, at least 10 000."""
    target = F.greatest(peak * 1.15, F.lit(10_000.0))
    # The logarithm may be a hair off a power of ten: start one power below what it says.
    power = F.pow(F.lit(10.0), F.floor(F.log10(target)) - 1)
    return F.get(F.filter(F.array(*[power * step for step in (5.0, 10.0, 20.0, 50.0, 100.0, 200.0)]),
                          lambda x: x >= target), F.lit(0))


def dial_series(sweeps: DataFrame, keys: list[str], order: str, chunk: Column) -> DataFrame:
    """Dial scale after every sweep: the peak decays by a fixed factor per sweep."""
    log_decay = math.log(PEAK_DECAY_PER_SWEEP)
    sweeps = settled(sweeps)  # the scans below read it, its own source is read once
    numbered = ordered_scan(sweeps, keys, [order], chunk, sweep=Running("sum", F.lit(1).cast("bigint")))
    level = F.when(F.col("value") > 0, F.ln("value") - F.col("sweep") * log_decay)
    scanned = ordered_scan(numbered, keys, [order], chunk, level=Running("max", level))
    peak = F.coalesce(F.exp(F.col("level") + F.col("sweep") * log_decay), F.lit(0.0))
    return scanned.withColumn("peak", peak).withColumn("scale", dial_scale(F.col("peak"))).drop("level")
