"""The snapshot report: today, month, all time, coverage, burn, limits, top lists as one row (SNK5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.functions import timecols
from meterline.functions.money import total_tokens, usd
from meterline.operators import ranking, rates, rollups
from meterline.operators.cube import MEASURES, build_cells, hot_only
from meterline.schemas import KNOWN_AGENTS, TOKEN_COLUMNS
from meterline.session import settled

BURN_WINDOW_MIN = 15
TOP_N = 10
MAX_PER_AGENT = 16


def _totals_struct() -> Column:
    return F.struct(total_tokens().alias("tokens"), *TOKEN_COLUMNS, "events", usd(F.col("cost_usd")).alias("cost_usd"))


def _with_split(by_agent: DataFrame) -> DataFrame:
    """Totals over all agents and the split; agents are a closed set, so the array is bounded."""
    summed = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in MEASURES]
    split = F.array_sort(F.collect_list(F.struct("agent", _totals_struct().alias("totals"))))
    return by_agent.agg(*summed, split.alias("by_agent")).select(F.struct(
        total_tokens().alias("tokens"), *TOKEN_COLUMNS, "events", usd(F.col("cost_usd")).alias("cost_usd"),
        "by_agent").alias("v"))


def _top(totals: DataFrame, name: str) -> DataFrame:
    top = ranking.top_by_cost(totals.filter(F.col(name) != ""), name, TOP_N)
    entry = F.struct((-F.col("cost_usd")).alias("a"), (-F.col("tokens")).alias("b"), F.col(name).alias("name"),
                     "tokens", "events", usd(F.col("cost_usd")).alias("cost_usd"))
    return top.agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(
        e["name"].alias("name"), e["tokens"].alias("tokens"), e["events"].alias("events"),
        e["cost_usd"].alias("cost_usd"))).alias("v"))


def snapshot(events: DataFrame, now_ms: int, tz_offset_min: int = 0, coverage: DataFrame | None = None,
             limits: DataFrame | None = None, prices: DataFrame | None = None) -> DataFrame:
    """One row of nested structs. Each part is an aggregate of the hourly cells; parts meet as
    scalar subqueries, so nothing but single rows is combined."""
    spark = events.sparkSession
    # Every part below reads the cells, so they are written once.
    cells = settled(rollups.hourly_cells(events, tz_offset_min, prices))
    today_key = (now_ms + tz_offset_min * 60_000) // timecols.DAY_MS
    minute = build_cells(hot_window(events, now_ms), "minute", 0, prices)
    hot = hot_only(minute, now_ms)
    burn = rates.burn_at(hot.filter(F.col("bucket") <= now_ms // timecols.MINUTE_MS), now_ms, BURN_WINDOW_MIN)
    month = rollups.month_rollup(cells, now_ms, tz_offset_min, by_agent=True)
    parts = {
        "today": _with_split(rollups.totals(cells.filter(F.col("day_key") == today_key), "agent")),
        "month": _with_split(month.select("agent", *MEASURES)),
        "all_time": _with_split(rollups.totals(cells, "agent")),
        "burn_tokens_per_min": burn.select(F.col("tokens_per_min").alias("v")),
        "history": _history(hot, cells, burn, tz_offset_min),
        "models": _top(rollups.totals(cells, "model"), "model"),
        "projects": _top(rollups.totals(cells, "project"), "project"),
    }
    for name, frame in (("coverage", coverage), ("limits", limits)):
        if frame is not None:
            # Rows of known agents, few for each: the row stays small whatever frame comes in.
            place = F.row_number().over(Window.partitionBy("agent").orderBy(*frame.columns))
            known = frame.filter(F.col("agent").isin(*KNOWN_AGENTS)).withColumn("__n", place).filter(F.col("__n") <= MAX_PER_AGENT).drop("__n")
            parts[name] = known.agg(F.array_sort(F.collect_list(F.struct(*frame.columns))).alias("v"))
    row = spark.range(1).select(F.lit(now_ms).alias("generated_at_ms"), F.lit(tz_offset_min).alias("tz_offset_min"))
    return row.select("*", *[part.select("v").scalar().alias(name) for name, part in parts.items()])


def hot_window(events: DataFrame, now_ms: int) -> DataFrame:
    """Only what the hot tier can hold: the filter reaches the scan of the events."""
    start = (now_ms - timecols.HOT_MAX_AGE_MS) // timecols.MINUTE_MS * timecols.MINUTE_MS
    return events.filter(F.col("ts_ms") >= start)


def _history(hot: DataFrame, cells: DataFrame, burn: DataFrame, tz_offset_min: int) -> DataFrame:
    minutes = hot.groupBy("bucket").agg(F.count("*").alias("n")).agg(F.count("*").alias("m"))
    span = cells.agg(F.min("hour_key").alias("lo"), F.max("hour_key").alias("hi"), F.count("*").alias("records"))
    shift = tz_offset_min * 60_000
    return span.select(F.struct(
        minutes.scalar().alias("hot_minutes"), (F.col("lo") * timecols.HOUR_MS - shift).alias("first_ms"),
        (F.col("hi") * timecols.HOUR_MS - shift).alias("last_ms"), "records",
        F.lit(BURN_WINDOW_MIN).alias("burn_window_min"),
        burn.select("cost_per_min").scalar().alias("burn_cost_per_min"),
        F.lit(tz_offset_min).alias("day_tz_offset_min")).alias("v"))
