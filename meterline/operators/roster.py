"""Session activity from signals (ST9-ST13).

Signals are rows (agent, session_id, kind 'event' | 'growth', at_ms, seq); `seq`
is the order of arrival. Growth of a file that names no session has a null session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.operators.bounded import broadcast_if_small
from meterline.operators.scan import Running, ordered_scan
from meterline.schemas import AGENTS
from meterline.session import settled

# Fixed values of the activity states.
RUNNING_WITHIN_MS = 2 * 60_000
MID_TURN_MS = 10 * 60_000
DONE_AFTER_MS = 30 * 60_000
STATES = ("running", "idle", "done")


def attribute_growth(signals: DataFrame, chunk: Column) -> DataFrame:
    """Growth without a session goes to the session of its agent that was most recently active.

    That session is the one behind the latest record of `at_ms`; unattributed
    growth raises the record and keeps the session. The record starts at the first
    signal that names a session.
    """
    signals = settled(signals)  # two scans and the first names read it: the source once
    first = broadcast_if_small(signals.filter(F.col("session_id").isNotNull()).groupBy("agent").agg(
        F.min("seq").alias("first_named")))
    counted = F.when(F.col("seq") >= F.col("first_named"), F.col("at_ms"))
    records = ordered_scan(signals.join(first, "agent", "left"), ["agent"], ["seq"], chunk,
                           newest=Running("max_before", counted))
    leads = F.when(F.col("session_id").isNotNull() & (F.col("newest").isNull() | (F.col("at_ms") > F.col("newest"))),
                   F.col("session_id"))
    led = ordered_scan(records.withColumn("leads", leads), ["agent"], ["seq"], chunk,
                       lead=Running("last", F.col("leads")))
    return led.withColumn("unattributed", F.col("session_id").isNull()).withColumn(
        "session_id", F.coalesce("session_id", "lead")).drop("newest", "leads", "lead", "first_named")


def states(signals: DataFrame, now_ms: int) -> DataFrame:
    """Per session: newest event and growth, mid-turn, state. Aggregates only, in arrival order where it counts."""
    named = signals.filter(F.col("session_id").isNotNull())
    grouped = named.groupBy("agent", "session_id").agg(
        F.coalesce(F.max(F.when(F.col("kind") == "event", F.col("at_ms"))), F.lit(0)).alias("last_event_ms"),
        F.coalesce(F.max(F.when(F.col("kind") == "growth", F.col("at_ms"))), F.lit(0)).alias("last_growth_ms"),
        F.max_by(F.col("kind") == "growth", "seq").alias("mid_turn"))
    last = F.greatest("last_event_ms", "last_growth_ms")
    state = activity_of(F.col("last_event_ms"), F.col("last_growth_ms"), F.col("mid_turn"), F.lit(now_ms))
    return grouped.withColumn("last_activity_ms", last).withColumn("state", state).withColumn(
        "state_rank", state_rank(F.col("state")))


def activity_of(event_ms: Column, growth_ms: Column, mid_turn: Column, now_ms: Column) -> Column:
    last = F.greatest(event_ms, growth_ms)
    age = now_ms - last
    return (F.when((last == 0) | (age > DONE_AFTER_MS), "done")
            .when(age <= RUNNING_WITHIN_MS, "running")
            .when(mid_turn & (now_ms - growth_ms <= MID_TURN_MS), "running")
            .otherwise("idle"))


def state_rank(state: Column) -> Column:
    return F.when(state == "running", 0).when(state == "idle", 1).otherwise(2).cast("bigint")


def growth_state(growth_ms: Column, now_ms: int) -> Column:
    age = F.lit(now_ms) - growth_ms
    return (F.when((growth_ms == 0) | (age > DONE_AFTER_MS), "done")
            .when(age <= MID_TURN_MS, "running").otherwise("idle"))


def agent_view(sessions: DataFrame, signals: DataFrame, now_ms: int) -> DataFrame:
    """Per agent: liveliest state, sessions, running sessions, summed rate, newest signal.

    `sessions` is `states` with a `tokens_per_min` column; growth of the agent
    itself counts for its state even without a session.
    """
    grown = signals.filter(F.col("kind") == "growth").groupBy("agent").agg(F.max("at_ms").alias("growth_ms"))
    summed = sessions.groupBy("agent").agg(
        F.min("state_rank").alias("rank"), F.count("*").alias("sessions"),
        F.count_if(F.col("state") == "running").alias("active_sessions"),
        F.sum("tokens_per_min").alias("tokens_per_min"), F.max("last_activity_ms").alias("last_ms"))
    both = summed.join(grown, "agent", "full")
    growth = F.coalesce("growth_ms", F.lit(0))
    rank = F.least(F.coalesce("rank", F.lit(2)), state_rank(growth_state(growth, now_ms)))
    order = F.create_map(*[F.lit(x) for name, i, _, _ in AGENTS for x in (name, i)])
    return both.select(
        "agent", F.get(F.array(*[F.lit(s) for s in STATES]), rank.cast("int")).alias("state"),
        rank.cast("bigint").alias("state_rank"), F.coalesce("sessions", F.lit(0)).alias("sessions"),
        F.coalesce("active_sessions", F.lit(0)).alias("active_sessions"),
        F.coalesce("tokens_per_min", F.lit(0.0)).alias("tokens_per_min"),
        F.greatest(F.coalesce("last_ms", F.lit(0)), growth).alias("last_activity_ms"),
        F.coalesce(order[F.col("agent")], F.lit(999)).cast("bigint").alias("agent_order"))


def live(sessions: DataFrame, agent: str | None = None) -> DataFrame:
    """Sessions that are not done, of one agent or all."""
    kept = sessions.filter(F.col("state") != "done")
    return kept.filter(F.col("agent") == agent) if agent else kept
