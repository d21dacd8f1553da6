"""Burn rates and token traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions import timecols
from meterline.functions.money import COST, limit_weighted_tokens, total_tokens
from meterline.operators.cube import MEASURES, sums
from meterline.operators.scan import dense, sliding_sum
from meterline.schemas import AGENTS

# Fixed values of the decayed rate.
BURN_MINUTES = 15
HALF_LIFE_MIN = 4.0
TOTAL_WEIGHT = sum(2.0 ** (-k / HALF_LIFE_MIN) for k in range(BURN_MINUTES))
IDLE_AFTER_MS = 5 * 60_000
TRACE_PERIOD_MS, TRACE_BUCKETS = 10_000, 120
SESSION_PERIOD_MS, SESSION_BUCKETS = 15_000, 40


def burn_at(minute_cells: DataFrame, at_ms: int, window_min: int = 15) -> DataFrame:
    """Raw tokens and cost over the window ending at an instant, per minute of the window."""
    window = max(window_min, 1)
    end = max(0, at_ms // timecols.MINUTE_MS)
    start = max(0, end - (window - 1))
    zeroed = [F.coalesce(c, F.lit(0).cast("bigint" if n != "cost_usd" else COST)).alias(n)
              for c, n in zip(sums(), MEASURES)]
    summed = minute_cells.filter(F.col("bucket").between(start, end)).agg(*zeroed)
    return summed.select(
        F.lit(at_ms).cast("bigint").alias("at_ms"), F.lit(window).cast("bigint").alias("window_min"),
        total_tokens().alias("tokens"), "events", "cost_usd",
        (total_tokens() / F.lit(float(window))).alias("tokens_per_min"),
        (F.col("cost_usd").cast("double") / F.lit(float(window))).alias("cost_per_min"),
        F.lit(window * timecols.MINUTE_MS > timecols.HOT_MAX_AGE_MS).alias("beyond_hot_tier"))


def burn_series(minute_cells: DataFrame, window_min: int = 15) -> DataFrame:
    """`burn_at` for every minute that has usage."""
    per_minute = minute_cells.groupBy("bucket").agg(*sums()).withColumn("tokens", total_tokens())
    summed = sliding_sum(per_minute.select("bucket", "tokens", "cost_usd"), [], "bucket", window_min,
                         ["tokens", "cost_usd"])
    return summed.select(
        "bucket", (F.col("window_tokens") / F.lit(float(window_min))).alias("tokens_per_min"),
        (F.col("window_cost_usd").cast(COST).cast("double") / F.lit(float(window_min))).alias("cost_per_min"))


def weighted_minutes(events: DataFrame, *keys: str) -> DataFrame:
    """Limit-weighted tokens per minute: the partial sums every decayed rate starts from."""
    return (events.withColumn("minute", timecols.floor_div(F.col("ts_ms"), timecols.MINUTE_MS))
            .groupBy("minute", *keys).agg(F.sum(limit_weighted_tokens()).alias("weighted")))


def _decayed(minutes: DataFrame, now_ms: int, *keys: str) -> DataFrame:
    now_minute = now_ms // timecols.MINUTE_MS
    age = F.greatest(F.lit(now_minute) - F.col("minute"), F.lit(0)).cast("double")
    weight = F.pow(F.lit(2.0), -age / F.lit(HALF_LIFE_MIN))
    live = minutes.filter(F.col("minute") > now_minute - BURN_MINUTES)
    return live.groupBy(*keys).agg((F.sum(F.col("weighted") * weight) / F.lit(TOTAL_WEIGHT))
                                   .alias("tokens_per_min"))


def burn_rate(events: DataFrame, now_ms: int) -> DataFrame:
    """Blended decayed rate at `now`. Minutes are summed as integers before they are weighted.

    The window is the 15 minutes ending at the newer of `now` and the newest event.
    """
    minutes = weighted_minutes(events.filter(_recent(now_ms)))
    head = minutes.agg(F.greatest(F.max("minute"), F.lit(now_ms // timecols.MINUTE_MS)))
    kept = minutes.filter(F.col("minute") > head.scalar() - BURN_MINUTES)
    return _decayed(kept, now_ms).select(F.coalesce("tokens_per_min", F.lit(0.0)).alias("tokens_per_min"))


def burn_by_agent(events: DataFrame, now_ms: int) -> DataFrame:
    """Decayed rate per agent; each agent's window ends at its own newest event or `now`."""
    minutes = weighted_minutes(events.filter(_recent(now_ms)), "agent")
    heads = minutes.groupBy("agent").agg(F.greatest(
        F.max("minute"), F.lit(now_ms // timecols.MINUTE_MS)).alias("head"))
    kept = minutes.join(heads, "agent").filter(F.col("minute") > F.col("head") - BURN_MINUTES)
    return _decayed(kept, now_ms, "agent")


def _recent(now_ms: int) -> Column:
    return F.col("ts_ms") >= (now_ms // timecols.MINUTE_MS - BURN_MINUTES + 1) * timecols.MINUTE_MS


def hottest(rates: DataFrame) -> DataFrame:
    """The agent with the highest positive rate, ties to agent order; no row when all are quiet."""
    order = F.create_map(*[F.lit(x) for name, i, _, _ in AGENTS for x in (name, i)])
    return rates.filter(F.col("tokens_per_min") > 0).orderBy(
        F.desc("tokens_per_min"), order[F.col("agent")]).limit(1)


def idle(events: DataFrame, now_ms: int, *keys: str) -> DataFrame:
    """Newest event and whether it is more than five minutes old."""
    return events.groupBy(*keys).agg(F.max("ts_ms").alias("last_event_ms")).withColumn(
        "idle", F.lit(now_ms) - F.col("last_event_ms") > IDLE_AFTER_MS)


def trace(events: DataFrame, now_ms: int, period_ms: int = TRACE_PERIOD_MS,
          buckets: int = TRACE_BUCKETS, keys: DataFrame | None = None) -> DataFrame:
    """Token counters in fixed periods ending with the one `now` is in; gaps are 0.

    `complete` is false for the open period, `fraction` is how much of it has passed.
    """
    newest = now_ms // period_ms
    names = keys.columns if keys is not None else []
    per_bucket = (events.withColumn("bucket", timecols.floor_div(F.col("ts_ms"), period_ms))
                  .filter(F.col("bucket").between(newest - buckets + 1, newest))
                  .groupBy(*names, "bucket").agg(F.sum(limit_weighted_tokens()).alias("tokens")))
    filled = dense(per_bucket, keys, "bucket", newest - buckets + 1, newest, zero=["tokens"])
    fraction = max((now_ms % period_ms) / period_ms, 1.0 / period_ms)
    return filled.withColumn("complete", F.col("bucket") < newest).withColumn(
        "fraction", F.when(F.col("complete"), F.lit(1.0)).otherwise(F.lit(fraction)))


def mean_per_min(events: DataFrame, now_ms: int, period_ms: int, buckets: int, *keys: str) -> DataFrame:
    """Flat mean over the whole window of a trace, empty periods included."""
    newest = now_ms // period_ms
    bucket = timecols.floor_div(F.col("ts_ms"), period_ms)
    window_min = period_ms * buckets / 60_000.0
    return events.filter(bucket.between(newest - buckets + 1, newest)).groupBy(*keys).agg(
        (F.coalesce(F.sum(limit_weighted_tokens()), F.lit(0)) / F.lit(window_min)).alias("tokens_per_min"))
