"""Ordered scans that never put one key into one task.

A running window over (key, order) sends all rows of a key to a single task.
Here the key is cut into consecutive chunks: windows run inside (key, chunk),
one summary row per chunk is combined across the chunks of a key, and the
combined value is carried into the next chunk. Hot keys become many tasks, the
summaries are aggregated map-side, and the result is the one of the plain window.

`chunk` must grow with the order (a day of the timestamp, a range of line
numbers, the file split); rows of one chunk need not be contiguous in storage.
Keys must not be null.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.functions.timecols import floor_div

_CHUNK = "__chunk"
_AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min, "sum_before": F.sum, "max_before": F.max}


@dataclass(frozen=True)
class Running:
    """One output column of a scan.

    kind: 'last'      latest non-null value at or before the row
          'last_before' latest non-null value strictly before the row
          'lag'       value of the preceding row, nulls kept
          'sum' | 'max' | 'min'  over all rows up to and including this one
          'sum_before' | 'max_before'  over all rows before this one
    """

    kind: str
    value: Column


def ordered_scan(df: DataFrame, keys: list[str], order: list[str], chunk: Column,
                 **outputs: Running) -> DataFrame:
    """`df` plus one column per output; see the module text for the shape of the plan."""
    source = df.withColumn(_CHUNK, chunk)
    inputs = {name: f"__in_{name}" for name in outputs}
    source = source.withColumns({inputs[n]: run.value for n, run in outputs.items()})

    part = [*keys, _CHUNK]
    upto = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = Window.partitionBy(*part).orderBy(*order)

    # A single order column keeps the summaries in a hash aggregate.
    position = F.struct(*order) if len(order) > 1 else F.col(order[0])
    summaries, local = [], {}
    for name, run in outputs.items():
        col = F.col(inputs[name])
        if run.kind in ("last", "last_before"):
            summaries.append(F.max_by(col, F.when(col.isNotNull(), position)).alias(f"__sum_{name}"))
            local[f"__loc_{name}"] = F.last(col, ignorenulls=True).over(
                upto if run.kind == "last" else before)
        elif run.kind == "lag":
            summaries.append(F.max_by(F.struct(col.alias("v")), position).alias(f"__sum_{name}"))
            local[f"__loc_{name}"] = F.lag(F.struct(col.alias("v"))).over(at)
        elif run.kind in _AGGREGATES:
            aggregate = _AGGREGATES[run.kind]
            summaries.append(aggregate(col).alias(f"__sum_{name}"))
            local[f"__loc_{name}"] = aggregate(col).over(
                before if run.kind.endswith("_before") else upto)
        else:
            raise ValueError(f"unknown scan {run.kind!r}")

    # One row per (key, chunk): small, and aggregated before it is shuffled.
    per_chunk = source.groupBy(*part).agg(*summaries)
    earlier = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    previous = Window.partitionBy(*keys).orderBy(_CHUNK)
    carries = []
    for name, run in outputs.items():
        summary = F.col(f"__sum_{name}")
        if run.kind in ("last", "last_before"):
            carry = F.last(summary, ignorenulls=True).over(earlier)
        elif run.kind == "lag":
            carry = F.lag(summary).over(previous)
        else:
            carry = _AGGREGATES[run.kind](summary).over(earlier)
        carries.append(carry.alias(f"__carry_{name}"))
    carried = per_chunk.select(*part, *carries)

    joined = source.withColumns(local).join(carried, part, "left")
    results = {}
    for name, run in outputs.items():
        loc, carry = F.col(f"__loc_{name}"), F.col(f"__carry_{name}")
        if run.kind in ("last", "last_before"):
            results[name] = F.coalesce(loc, carry)
        elif run.kind == "lag":
            results[name] = F.coalesce(loc, carry)["v"]
        elif run.kind in ("sum", "sum_before"):
            results[name] = F.when(loc.isNull(), carry).when(carry.isNull(), loc).otherwise(loc + carry)
        elif run.kind in ("max", "max_before"):
            results[name] = F.greatest(loc, carry)
        else:
            results[name] = F.least(loc, carry)
    keep = [F.col(f"`{c}`") for c in df.columns if c not in results]
    return joined.select(*keep, *[expr.alias(name) for name, expr in results.items()])


# Rows of an order column per chunk: small enough for one task, large enough that even
# 10^12 rows of one key leave only millions of chunk summaries.
CHUNK_ROWS = 250_000


def chunk_of(value: Column, size: int = CHUNK_ROWS) -> Column:
    """Consecutive ranges of an integer order column."""
    return floor_div(value, size)


def sliding_sum(df: DataFrame, keys: list[str], bucket: str, width: int,
                measures: list[str], chunk_len: int = 1440) -> DataFrame:
    """Sum of each measure over the `width` buckets ending at every bucket present.

    `df` has one row per (keys, bucket). Ranges of `chunk_len` buckets run apart;
    the `width - 1` buckets before a range are copied into it.
    """
    chunk_len = max(chunk_len, width)
    own = chunk_of(F.col(bucket), chunk_len)
    reach = chunk_of(F.col(bucket) + (width - 1), chunk_len)
    spread = (df.withColumn("__own", own)
              .withColumn(_CHUNK, F.explode(F.sequence(own, reach))))
    frame = (Window.partitionBy(*keys, _CHUNK).orderBy(bucket)
             .rangeBetween(-(width - 1), 0))
    summed = spread.withColumns({f"window_{m}": F.sum(m).over(frame) for m in measures})
    return summed.filter(F.col(_CHUNK) == F.col("__own")).drop(_CHUNK, "__own")


def dense(df: DataFrame, keys: DataFrame | None, bucket: str, low: int, high: int,
          zero: list[str] = ()) -> DataFrame:
    """One row per key and bucket in [low, high]; `zero` columns read 0 in a gap, others null.

    `keys` is a frame of distinct keys, or None for a single series. The calendar
    has `high - low + 1` rows per key, set by the caller's arguments.
    """
    spark = df.sparkSession
    if keys is None:
        calendar = spark.range(low, high + 1).select(F.col("id").alias(bucket))
        on = [bucket]
    else:
        calendar = keys.withColumn(bucket, F.explode(F.sequence(
            F.lit(low).cast("long"), F.lit(high).cast("long"))))
        on = [*keys.columns, bucket]
    inside = df.filter(F.col(bucket).between(low, high))
    filled = calendar.join(inside, on, "left")
    return filled.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType))
                               for c in zero}) if zero else filled


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
