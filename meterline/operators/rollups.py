"""Rollups of usage over time, agents, models, projects and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.functions import timecols
from meterline.functions.money import COST, total_tokens
from meterline.operators.cube import MEASURES, covered_flag, sums
from meterline.operators.pricing import price
from meterline.operators.scan import dense
from meterline.schemas import AGENTS, DIMENSIONS, TOKEN_COLUMNS

def zero_cost() -> Column:
    return F.lit(0).cast(COST)


def hourly_cells(events: DataFrame, tz_offset_min: int = 0, prices: DataFrame | None = None,
                 rates: DataFrame | None = None, keep: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Events -> priced cells per (local hour, agent, model, project, session).

    The one place the rollups read events; everything below sums these cells. A
    rollup over few dimensions names them in `keep`.
    """
    kept = [d for d in DIMENSIONS if d in keep or d in ("agent", "model")]
    cells = (events.withColumn("hour_key", timecols.local_hour_key(F.col("ts_ms"), tz_offset_min))
             .groupBy("hour_key", *kept).agg(*sums(TOKEN_COLUMNS), F.count("*").alias("events")))
    return (price(cells, prices, rates)
            .withColumn("cost_usd", F.coalesce("cost_usd", zero_cost()))
            .withColumn("day_key", timecols.day_of_hour(F.col("hour_key")))
            .withColumn("covered", covered_flag(F.col("agent"))))


def rollup(cells: DataFrame) -> DataFrame:
    """All rollup dimensions in one pass over the cells.

    One row per member of: all, agent, day, hour x agent, session, model, project.
    Blank session, model and project are not members of their own dimension.
    """
    keys = ["agent", "day_key", "hour_key", "session_id", "model", "project"]
    sets = [[], ["agent"], ["day_key"], ["hour_key", "agent"], ["session_id"], ["model"], ["project"]]
    covered = F.sum(F.when(F.col("covered"), F.col("cost_usd")).otherwise(zero_cost())).cast(COST)
    grouped = cells.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(
        *sums(), covered.alias("covered_cost_usd"),
        *[F.grouping(k).alias(f"__{k}") for k in keys])

    def only(*present: str) -> Column:
        test = F.lit(True)
        for k in keys:
            test = test & (F.col(f"__{k}") == (0 if k in present else 1))
        return test

    dimension = (F.when(only("agent"), "agent").when(only("day_key"), "day")
                 .when(only("hour_key", "agent"), "hour_agent").when(only("session_id"), "session")
                 .when(only("model"), "model").when(only("project"), "project").otherwise("all"))
    member = (F.when(only("hour_key", "agent"), F.concat_ws("/", F.col("hour_key").cast("string"), "agent"))
              .otherwise(F.coalesce("agent", F.col("day_key").cast("string"), "session_id", "model",
                                    "project", F.lit("all"))))
    return (grouped.select(dimension.alias("dimension"), member.alias("member"), *MEASURES,
                           "covered_cost_usd")
            .filter(~(F.col("dimension").isin("session", "model", "project") & (F.col("member") == ""))))


def totals(cells: DataFrame, *group_by: str) -> DataFrame:
    return cells.groupBy(*group_by).agg(*sums())


def today(cells: DataFrame, now_ms: int, tz_offset_min: int = 0) -> DataFrame:
    day = (now_ms + tz_offset_min * 60_000) // timecols.DAY_MS
    return totals(cells.filter(F.col("day_key") == day))


def this_hour(cells: DataFrame, now_ms: int, tz_offset_min: int = 0) -> DataFrame:
    hour = (now_ms + tz_offset_min * 60_000) // timecols.HOUR_MS
    return totals(cells.filter(F.col("hour_key") == hour))


def in_range(cells: DataFrame, from_ms: int, to_ms: int, tz_offset_min: int = 0,
             by_agent: bool = False, agent: str | None = None) -> DataFrame:
    """Half-open window; an hour counts when it starts inside."""
    start = timecols.hour_start_ms(F.col("hour_key"), tz_offset_min)
    hits = cells.filter((start >= from_ms) & (start < to_ms))
    if agent:
        hits = hits.filter(F.col("agent") == agent)
    return totals(hits, *(["agent"] if by_agent else []))


def month_rollup(cells: DataFrame, now_ms: int, tz_offset_min: int = 0, by_agent: bool = False) -> DataFrame:
    """The local calendar month `now` falls in: totals, covered cost, active days, length."""
    today_key = (now_ms + tz_offset_min * 60_000) // timecols.DAY_MS
    first = F.trunc(F.date_add(F.lit("1970-01-01").cast("date"), F.lit(int(today_key))), "month")
    month = cells.filter(timecols.month_of_day(F.col("day_key")) == first)
    group = ["agent"] if by_agent else []
    # Days first, so counting active days is a plain count and not a distinct.
    days = month.groupBy("day_key", *group).agg(
        *sums(), F.sum(F.when(F.col("covered"), F.col("cost_usd")).otherwise(zero_cost()))
        .cast(COST).alias("covered_cost_usd"))
    return days.groupBy(*group).agg(
        *sums(), F.sum("covered_cost_usd").cast(COST).alias("covered_cost_usd"),
        F.count_if(F.col("events") > 0).alias("active_days")).withColumns({
            "first_day_key": F.datediff(first, F.lit("1970-01-01").cast("date")).cast("bigint"),
            "day_count": F.dayofmonth(F.last_day(first)).cast("bigint")})


def covered_cost(cells: DataFrame, first_day: int, day_count: int) -> DataFrame:
    return cells.filter(F.col("covered") & F.col("day_key").between(first_day, first_day + day_count - 1)).agg(
        F.coalesce(F.sum("cost_usd").cast(COST), zero_cost()).alias("covered_cost_usd"))


def sessions(events: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Per session id: totals, first and last event, the agent that opened it.

    `order_key` is the arrival order of the events.
    """
    partial = events.filter(F.col("session_id") != "").groupBy("session_id", "model").agg(
        *sums(TOKEN_COLUMNS), F.count("*").alias("events"), F.min("ts_ms").alias("first_ms"),
        F.max("ts_ms").alias("last_ms"), F.min(F.struct("order_key", "agent")).alias("opened"))
    return price(partial, prices).groupBy("session_id").agg(
        *sums(), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"),
        F.min("opened")["agent"].alias("agent"))


def session_spans(cube_cells: DataFrame, tier: str = "day", tz_offset_min: int = 0) -> DataFrame:
    """Per (session, agent): totals, first and last bucket start, and the project of the
    heaviest single (bucket, project) row - first by bucket, then name, on ties; '' if all are empty."""
    rows = cube_cells.groupBy("session_id", "agent", "project", "bucket").agg(*sums())
    tokens = total_tokens()
    # The smallest (-tokens, bucket, project) is the heaviest, earliest, first-named row.
    heaviest = F.min(F.when(tokens > 0, F.struct((-tokens).alias("t"), "bucket", "project")))
    spans = rows.groupBy("session_id", "agent").agg(
        *sums(), F.min("bucket").alias("first_bucket"), F.max("bucket").alias("last_bucket"),
        heaviest.alias("top"))
    return spans.select(
        "session_id", "agent", F.coalesce(F.col("top.project"), F.lit("")).alias("project"), *MEASURES,
        timecols.bucket_start_ms(tier, F.col("first_bucket"), tz_offset_min).alias("first_ms"),
        timecols.bucket_start_ms(tier, F.col("last_bucket"), tz_offset_min).alias("last_ms"))


def trailing(cells: DataFrame, unit: str, now_ms: int, length: int, tz_offset_min: int = 0) -> DataFrame:
    """The `length` newest hours or days, oldest first, gaps as zero; `partial` marks the open bucket."""
    step = timecols.HOUR_MS if unit == "hour" else timecols.DAY_MS
    newest = (now_ms + tz_offset_min * 60_000) // step
    key = f"{unit}_key"
    per_bucket = totals(cells.filter(F.col(key).between(newest - length + 1, newest)), key)
    return (dense(per_bucket, None, key, newest - length + 1, newest, zero=list(MEASURES))
            .withColumn("partial", F.col(key) == newest))


def trip(events: DataFrame, start_ms: int, now_ms: int, prices: DataFrame | None = None) -> DataFrame:
    """Totals of events at or after a start; cost per hour is null in the first minute."""
    partial = events.filter(F.col("ts_ms") >= start_ms).groupBy("model").agg(
        *sums(TOKEN_COLUMNS), F.count("*").alias("events"))
    elapsed = now_ms - start_ms
    summed = price(partial, prices).agg(*[F.coalesce(c, F.lit(0)).alias(n) for c, n in
                                          zip(sums(), MEASURES)])
    rate = (F.col("cost_usd").cast("double") * 3_600_000 / elapsed if start_ms > 0 and elapsed >= 60_000
            else F.lit(None).cast("double"))
    return summed.withColumn("cost_per_hour", rate)


def subscription_value(month_by_agent: DataFrame, lifetime_by_agent: DataFrame, plans: DataFrame,
                       plan_prices: DataFrame) -> DataFrame:
    """Plan cost of the quota agents against what their month would have cost at API rates.

    The multiple divides by the high end of the plans and is null when an agent
    with usage has no priced plan.
    """
    quota = [name for name, _, covered, _ in AGENTS if covered]
    priced = plans.withColumn("plan_key", F.lower("plan")).join(
        F.broadcast(plan_prices.withColumnRenamed("plan", "plan_key")), ["agent", "plan_key"], "left")
    usage = lifetime_by_agent.filter(F.col("agent").isin(quota)).select("agent", "events")
    month = month_by_agent.filter(F.col("agent").isin(quota)).select("agent", "cost_usd")
    joined = priced.join(usage, "agent", "full").join(month, "agent", "full")
    summed = joined.agg(
        F.coalesce(F.sum("plan_lo"), F.lit(0.0)).alias("plan_lo_usd"),
        F.coalesce(F.sum("plan_hi"), F.lit(0.0)).alias("plan_hi_usd"),
        F.coalesce(F.max(F.col("plan_hi").isNull() & (F.coalesce("events", F.lit(0)) > 0)),
                   F.lit(False)).alias("incomplete"),
        F.coalesce(F.sum("cost_usd").cast(COST), zero_cost()).alias("covered_month_cost_usd"))
    return summed.withColumn("multiple", F.when(
        ~F.col("incomplete") & (F.col("plan_hi_usd") > 0),
        F.col("covered_month_cost_usd").cast("double") / F.col("plan_hi_usd")))


def others(cells: DataFrame) -> DataFrame:
    """The quota agents by name and everything else as one row with its number of active agents."""
    per_agent = totals(cells, "agent").filter(F.col("events") > 0)
    group = F.when(covered_flag(F.col("agent")), F.col("agent")).otherwise("others")
    return per_agent.groupBy(group.alias("agent_group")).agg(
        *sums(), F.count("*").alias("active_agents"))


def agent_rank(cells: DataFrame) -> DataFrame:
    """Agents with events or cost, dearest first, ties in agent order."""
    ranks = F.create_map(*[F.lit(x) for name, i, _, _ in AGENTS for x in (name, i)])
    return totals(cells, "agent").filter((F.col("events") != 0) | (F.col("cost_usd") != 0)).withColumn(
        "agent_order", F.coalesce(ranks[F.col("agent")], F.lit(999)))


def cost_share(cells: DataFrame, top: int = 6) -> DataFrame:
    """Share of the cost per agent; agents after the first `top` become "other".

    Agents are a closed set of at most 256 ids, so one ordering window over them is bounded.
    """
    ranked = agent_rank(cells)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("cost_usd"), "agent_order"))
    labelled = ranked.withColumn("place", place).withColumn(
        "segment", F.when(F.col("place") <= top, F.col("agent")).otherwise("other"))
    summed = labelled.groupBy("segment").agg(F.sum("cost_usd").cast(COST).alias("cost_usd"),
                                             F.min("place").cast("bigint").alias("place"))
    total = ranked.agg(F.sum("cost_usd").cast("double"))
    return summed.withColumn("total", total.scalar()).withColumn(
        "share", F.when(F.col("total") > 0, F.col("cost_usd").cast("double") / F.col("total"))
        .otherwise(F.lit(0.0))).drop("total")


def fleet_counts(roster: DataFrame) -> DataFrame:
    """Sessions live, running and seen, agents with a session."""
    return roster.agg(
        F.count_if(F.col("state") != "done").alias("live"),
        F.count_if(F.col("state") == "running").alias("running"),
        F.count("*").alias("seen"))


# Scope, unit, number of buckets.
SCOPES = {"12H": ("hour", 12), "24H": ("hour", 24), "7D": ("day", 7), "30D": ("day", 30), "90D": ("day", 90)}


def scoped_frame(cells: DataFrame, scope: str, now_ms: int, tz_offset_min: int = 0) -> DataFrame:
    """Series of one scope: cost of complete buckets, the open one apart as `partial`, labels."""
    unit, length = SCOPES[scope]
    key = f"{unit}_key"
    frame = trailing(cells, unit, now_ms, length, tz_offset_min)
    if unit == "hour":
        label = F.lpad(F.pmod(F.col(key), F.lit(24)).cast("string"), 2, "0")
    else:
        civil = F.date_add(F.lit("1970-01-01").cast("date"), F.col(key).cast("int"))
        label = F.concat_ws("/", F.month(civil).cast("string"), F.dayofmonth(civil).cast("string"))
    return frame.select(
        F.col(key).alias("bucket"), label.alias("label"), total_tokens().alias("tokens"), "events",
        F.when(F.col("partial"), zero_cost()).otherwise(F.col("cost_usd")).alias("cost_usd"),
        F.when(F.col("partial"), F.col("cost_usd")).otherwise(zero_cost()).alias("partial_cost_usd"))


def scoped_summary(cells: DataFrame, scope: str, now_ms: int, tz_offset_min: int = 0) -> DataFrame:
    """Totals and peak of a scope; the split per agent is exact for every scope."""
    frame = scoped_frame(cells, scope, now_ms, tz_offset_min)
    both = F.col("cost_usd") + F.col("partial_cost_usd")
    return frame.agg(F.lit(scope).alias("scope"), F.sum("tokens").alias("tokens"),
                     F.sum("events").alias("events"), F.sum(both).cast(COST).alias("cost_usd"),
                     F.max(both).cast(COST).alias("peak_usd"))


def scoped_agents(cells: DataFrame, scope: str, now_ms: int, tz_offset_min: int = 0) -> DataFrame:
    unit, length = SCOPES[scope]
    step = timecols.HOUR_MS if unit == "hour" else timecols.DAY_MS
    newest = (now_ms + tz_offset_min * 60_000) // step
    return totals(cells.filter(F.col(f"{unit}_key").between(newest - length + 1, newest)), "agent")
