"""Fixed schemas and the small dimensions (agents, plan prices)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TOKEN_COLUMNS = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")
DIMENSIONS = ("agent", "model", "project", "session_id")
TIERS = ("minute", "hour", "day")

USAGE_EVENT = T.StructType([
    T.StructField("agent", T.StringType(), False),
    T.StructField("ts_ms", T.LongType(), False),
    T.StructField("model", T.StringType(), False),
    T.StructField("input_tokens", T.LongType(), False),
    T.StructField("output_tokens", T.LongType(), False),
    T.StructField("cache_creation_tokens", T.LongType(), False),
    T.StructField("cache_read_tokens", T.LongType(), False),
    T.StructField("session_id", T.StringType(), False),
    T.StructField("cwd", T.StringType(), False),
    T.StructField("dedup_key", T.StringType(), True),
    T.StructField("source_file", T.StringType(), True),
    T.StructField("line_start", T.LongType(), True),
    T.StructField("line_seq", T.LongType(), True),
])

# Agent name, frozen storage id, covered by a subscription, has a collector.
AGENTS = [
    ("claude", 1, True, True),
    ("codex", 2, True, True),
    ("opencode", 3, False, True),
    ("pi", 4, False, True),
    ("gemini", 5, False, True),
    ("qwen", 6, False, True),
    ("kimi", 7, False, True),
    ("goose", 8, False, True),
    ("kilo", 9, False, True),
    ("cline", 10, False, True),
    ("roo", 11, False, True),
    ("copilot", 12, False, False),
    ("continue", 13, False, False),
    ("droid", 14, False, False),
]
SYNTHETIC_AGENT_ID = 255
COVERED_AGENTS = [name for name, _, covered, _ in AGENTS if covered]
KNOWN_AGENTS = [name for name, _, _, _ in AGENTS]

# Agent, plan, lowest and highest USD per month.
PLAN_PRICES = [
    ("claude", "pro", 20.0, 20.0),
    ("claude", "max", 100.0, 200.0),
    ("codex", "plus", 20.0, 20.0),
    ("codex", "pro", 200.0, 200.0),
    ("codex", "free", 0.0, 0.0),
]

LIMIT_KINDS = ("five_hour", "weekly", "weekly_opus", "weekly_sonnet", "monthly")


def _local(spark: SparkSession, rows: list[tuple], names: str, casts: dict[str, str]) -> DataFrame:
    """A literal relation: its size is known to the optimizer and reading it starts no job."""
    def literal(value) -> str:
        return f"'{value}'" if isinstance(value, str) else str(value).lower()

    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    columns = ", ".join(f"CAST({n} AS {casts[n]}) AS {n}" if n in casts else n for n in names.split(", "))
    return spark.sql(f"SELECT {columns} FROM VALUES {values} AS t({names})")


def agents(spark: SparkSession) -> DataFrame:
    """14 rows, fixed size."""
    return _local(spark, AGENTS, "agent, agent_id, covered, has_collector", {})


def plan_prices(spark: SparkSession) -> DataFrame:
    """5 rows, fixed size."""
    return _local(spark, PLAN_PRICES, "agent, plan, plan_lo, plan_hi", {"plan_lo": "double", "plan_hi": "double"})
