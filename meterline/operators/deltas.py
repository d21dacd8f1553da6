"""File-scoped carry-forward and cumulative counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.operators.scan import Running, ordered_scan


def carry_context(lines: DataFrame, keys: list[str], order: list[str], chunk: Column,
                  context: dict[str, Column]) -> DataFrame:
    """Latest non-null context value at or before each line of a file, per column."""
    return ordered_scan(lines, keys, order, chunk,
                        **{name: Running("last", value) for name, value in context.items()})


def counter_deltas(rows: DataFrame, current: str, previous: str, counters: list[str]) -> DataFrame:
    """`delta_<counter>` of a struct of cumulative counters against the struct before it.

    The first reading counts whole. If any counter falls, the counters restarted and
    the reading counts whole. A reading that adds nothing is dropped.
    """
    fell = reduce(lambda a, b: a | b, [F.col(f"{current}.{c}") < F.col(f"{previous}.{c}") for c in counters])
    whole = F.col(previous).isNull() | fell
    deltas = {f"delta_{c}": F.when(whole, F.col(f"{current}.{c}")).otherwise(
        F.col(f"{current}.{c}") - F.col(f"{previous}.{c}")) for c in counters}
    moved = reduce(lambda a, b: a | b, [F.col(name) != 0 for name in deltas])
    return rows.withColumns(deltas).filter(moved).drop(current, previous)


def cumulative_deltas(readings: DataFrame, keys: list[str], order: list[str], chunk: Column,
                      counters: list[str]) -> DataFrame:
    """`counter_deltas` of each reading against the reading before it; a dropped reading still is a base."""
    reading = F.struct(*counters)
    stepped = ordered_scan(readings.withColumn("reading", reading), keys, order, chunk,
                           prev=Running("lag", F.col("reading")))
    return counter_deltas(stepped, "reading", "prev", counters)
