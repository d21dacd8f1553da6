"""Sort, limit and top-k reports (T1-T8). A limit here is the feature, applied per partition first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterline.functions.money import COST, total_tokens
from meterline.operators.cube import query, sums


def top_by(cells: DataFrame, dimension: str, n: int, from_bucket: int = 0,
           to_bucket: int = 4294967295) -> DataFrame:
    """The N heaviest members of one dimension: tokens, then cost, then name."""
    grouped = query(cells, [dimension], from_bucket=from_bucket, to_bucket=to_bucket)
    return (grouped.withColumn("tokens", total_tokens())
            .orderBy(F.desc("tokens"), F.desc("cost_usd"), dimension).limit(n))


def top_by_cost(totals: DataFrame, name: str, n: int = 10) -> DataFrame:
    return (totals.withColumn("tokens", total_tokens())
            .orderBy(F.desc("cost_usd"), F.desc("tokens"), name).limit(n))


def newest_sessions(spans: DataFrame, n: int) -> DataFrame:
    return (spans.withColumn("tokens", total_tokens())
            .orderBy(F.desc("last_ms"), F.desc("tokens"), "session_id", "agent").limit(n))


def sorted_with_remainder(totals: DataFrame, name: str, sort_by: str = "cost", descending: bool = True,
                          shown: int = 20) -> DataFrame:
    """The first `shown` rows in the chosen order, and one row for the rest: count and cost.

    'activity' reads as cost. The rest is total minus shown, so nothing is ranked as a whole.
    """
    rows = totals.withColumn("tokens", total_tokens())
    column = {"cost": "cost_usd", "activity": "cost_usd", "tokens": "tokens", "name": name}[sort_by]
    # For names "descending" is the primary direction of the table: A first.
    down = descending if column != name else not descending
    ordering = [F.desc(column) if down else F.asc(column), F.asc(name)]
    head = rows.orderBy(*ordering).limit(shown).select(
        F.col(name).alias("name"), "tokens", "cost_usd", "events", F.lit(1).cast("bigint").alias("rows"))
    signed = head.select((-F.col("rows")).alias("r"), (-F.col("cost_usd")).alias("c"),
                         (-F.col("tokens")).alias("t"), (-F.col("events")).alias("e")).unionAll(
        rows.select(F.lit(1).cast("bigint"), F.col("cost_usd"), F.col("tokens"), F.col("events")))
    rest = signed.agg(F.sum("t").alias("tokens"), F.sum("c").cast(COST).alias("cost_usd"),
                      F.sum("e").alias("events"), F.sum("r").alias("rows")).filter(F.col("rows") > 0)
    return head.withColumn("cost_usd", F.col("cost_usd").cast(COST)).unionByName(
        rest.withColumn("name", F.lit("(rest)")))


def keep_recent(df: DataFrame, n: int, keys: list[str], newest: list[str]) -> DataFrame:
    """The N most recent rows per key. The row_number filter becomes a per-partition
    group limit before the shuffle, so a hot key sends N rows per map task."""
    order = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in newest])
    return df.withColumn("__place", F.row_number().over(order)).filter(F.col("__place") <= n).drop("__place")


def by_burn(agent_view: DataFrame) -> DataFrame:
    """Agents that burn or are not done; rate, then liveliness, then agent order."""
    return agent_view.filter((F.col("tokens_per_min") > 0) | (F.col("state") != "done")).orderBy(
        F.desc("tokens_per_min"), "state_rank", "agent_order")


def display_order(sessions: DataFrame) -> DataFrame:
    """Running, idle, done; then rate; then newest."""
    return sessions.orderBy("state_rank", F.desc("tokens_per_min"), F.desc("last_activity_ms"),
                            "agent", "session_id")
