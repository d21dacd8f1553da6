"""Token arithmetic and exact money.

Rates carry 12 decimals and tokens none, so tokens x rate is exact at scale 12
and summing tokens first gives the same cost as summing costs. That lets every
rollup add BIGINT tokens per model before it touches a decimal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RATE = "decimal(18,12)"
COST = "decimal(38,12)"
_TERM = "decimal(34,12)"


def total_tokens() -> Column:
    return (F.col("input_tokens") + F.col("output_tokens")
            + F.col("cache_creation_tokens") + F.col("cache_read_tokens"))


def limit_weighted_tokens() -> Column:
    """Cache reads press on a quota at a tenth of their count."""
    return (F.col("input_tokens") + F.col("output_tokens") + F.col("cache_creation_tokens")
            + F.expr("cache_read_tokens div 10"))


def cost_of(input_rate: Column, output_rate: Column, creation_rate: Column, read_rate: Column) -> Column:
    """Exact USD of the four counters; null as soon as the rates are null (unpriced is not free)."""
    def term(tokens: str, rate: Column) -> Column:
        return (F.col(tokens).cast("decimal(19,0)") * rate.cast(RATE)).cast(_TERM)

    return (term("input_tokens", input_rate) + term("output_tokens", output_rate)
            + term("cache_creation_tokens", creation_rate)
            + term("cache_read_tokens", read_rate)).cast(COST)


def usd(cost: Column) -> Column:
    """Six decimals at the edge: round the decimal, then leave it."""
    return F.round(cost, 6).cast("double")


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))
