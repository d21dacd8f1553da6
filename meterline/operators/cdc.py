"""Change capture on sources that are rewritten in place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.functions.money import COST
from meterline.operators.pricing import price
from meterline.operators.scan import Running, ordered_scan
from meterline.schemas import TOKEN_COLUMNS

VERSION_FIELDS = ("ts_ms", "model", *TOKEN_COLUMNS, "session_id", "cwd")


def last_in_snapshot(records: DataFrame, keys: list[str], position: list[str]) -> DataFrame:
    """A key repeated inside one snapshot: the later record replaces the earlier."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in position])
    return records.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") == 1).drop("__n")


def _record(prefix: str, fields: tuple[str, ...]) -> Column:
    return F.struct(*[F.col(f"{prefix}.{f}").alias(f) for f in fields])


def changes(stored: DataFrame, snapshot: DataFrame, keys: list[str],
            fields: tuple[str, ...] = VERSION_FIELDS) -> DataFrame:
    """What a new snapshot changes against the stored versions: (op, keys, prev, curr).

    New keys are added, changed ones replaced, equal ones silent; a vanished key
    says nothing because its spend happened. Both sides hold a key once, so the
    join has no hot keys.
    """
    s, n = stored.alias("s"), snapshot.alias("n")
    on = reduce(lambda a, b: a & b, [F.col(f"s.{k}") == F.col(f"n.{k}") for k in keys])
    joined = n.join(s, on, "left").select(
        *[F.col(f"n.{k}").alias(k) for k in keys],
        F.when(F.col(f"s.{keys[0]}").isNotNull(), _record("s", fields)).alias("prev"),
        _record("n", fields).alias("curr"))
    return (joined.filter(~F.col("prev").eqNullSafe(F.col("curr")))
            .withColumn("op", F.when(F.col("prev").isNull(), "add").otherwise("replace")))


def merged(stored: DataFrame, snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """The stored versions after a snapshot: its records, and every other record unchanged."""
    kept = stored.join(snapshot.select(*keys), keys, "left_anti")
    return snapshot.unionByName(kept.select(snapshot.columns))


def version_changes(versions: DataFrame, keys: list[str], version: str, chunk: Column,
                    fields: tuple[str, ...] = VERSION_FIELDS) -> DataFrame:
    """The same over a log of versions: each version against the one before it."""
    record = F.struct(*fields)
    stepped = ordered_scan(versions, keys, [version], chunk, prev=Running("lag", record))
    return (stepped.withColumn("curr", record).filter(~F.col("prev").eqNullSafe(F.col("curr")))
            .select(*keys, version, "prev", "curr",
                    F.when(F.col("prev").isNull(), "add").otherwise("replace").alias("op")))


def applied(totals: DataFrame, priced_changes: DataFrame, group_by: list[str]) -> DataFrame:
    """Totals after retracting every old version and adding every new one; exact.

    `priced_changes` carries prev/curr structs with the grouping columns, tokens
    and `cost_usd`. Tokens stop at 0, a cost below 1e-12 is 0, and a replacement
    leaves the event count alone.
    """
    def signed(side: str, sign: int) -> Column:
        return F.when(F.col(side).isNotNull(), F.struct(
            *[F.col(f"{side}.{g}").alias(g) for g in group_by],
            *[(F.col(f"{side}.{c}") * sign).alias(c) for c in TOKEN_COLUMNS],
            F.lit(sign).cast("bigint").alias("events"),
            (F.coalesce(F.col(f"{side}.cost_usd"), F.lit(0).cast(COST)) * sign).cast(COST).alias("cost_usd")))

    base = totals.select(*group_by, *TOKEN_COLUMNS, "events", "cost_usd")
    moves = priced_changes.select(F.explode(F.array(signed("prev", -1), signed("curr", 1))).alias("m")).filter(
        F.col("m").isNotNull()).select("m.*")
    summed = base.unionByName(moves).groupBy(*group_by).agg(
        *[F.sum(c).cast("bigint").alias(c) for c in (*TOKEN_COLUMNS, "events")],
        F.sum("cost_usd").cast(COST).alias("cost_usd"))
    return _floored(summed)


def applied_versions(first: DataFrame, found: DataFrame, group_by: list[str], prices: DataFrame | None = None) -> DataFrame:
    """`applied` from versions without costs: old and new versions are signed rows of one frame, summed per group and model, and
    only those sums are priced. Exact, as a cost is tokens times rates. `found` is `changes` of the same fields.
    """
    names = list(dict.fromkeys([*group_by, "model"]))

    def signed(side: str, sign: int) -> Column:
        return F.when(F.col(side).isNotNull(), F.struct(
            *[F.col(f"{side}.{n}").alias(n) for n in names], *[(F.col(f"{side}.{c}") * sign).alias(c) for c in TOKEN_COLUMNS],
            F.lit(sign).cast("bigint").alias("events")))

    moves = found.select(F.explode(F.array_compact(F.array(signed("prev", -1), signed("curr", 1)))).alias("m")).select("m.*")
    rows = first.select(*names, *TOKEN_COLUMNS, F.lit(1).cast("bigint").alias("events")).unionByName(moves)
    sums = [F.sum(c).cast("bigint").alias(c) for c in (*TOKEN_COLUMNS, "events")]
    priced = price(rows.groupBy(*names).agg(*sums), prices).withColumn("cost_usd", F.coalesce("cost_usd", F.lit(0).cast(COST)))
    totals = priced.groupBy(*group_by).agg(*sums, F.sum("cost_usd").cast(COST).alias("cost_usd"))
    return _floored(totals)


def _floored(totals: DataFrame) -> DataFrame:
    floor = {c: F.greatest(F.lit(0).cast("bigint"), F.col(c)) for c in (*TOKEN_COLUMNS, "events")}
    tiny = F.abs("cost_usd") < F.lit("0.000000000001").cast(COST)
    return totals.withColumns({**floor, "cost_usd": F.when(tiny, F.lit(0).cast(COST)).otherwise(F.col("cost_usd"))})


def delta_events(priced_changes: DataFrame) -> DataFrame:
    """Changes -> additive rows for the cube and the rate windows.

    A change is one more event; tokens count only their growth; the cost
    difference may be negative and is null when neither version has a price.
    """
    def grown(column: str) -> Column:
        before = F.coalesce(F.col(f"prev.{column}"), F.lit(0).cast("bigint"))
        return F.greatest(F.lit(0).cast("bigint"), F.col(f"curr.{column}") - before)

    none_priced = F.col("curr.cost_usd").isNull() & F.col("prev.cost_usd").isNull()
    zero = F.lit(0).cast(COST)
    cost = F.when(~none_priced, (F.coalesce(F.col("curr.cost_usd"), zero)
                                 - F.coalesce(F.col("prev.cost_usd"), zero)).cast(COST))
    carried = [f for f in priced_changes.schema["curr"].dataType.names
               if f not in (*TOKEN_COLUMNS, "cost_usd")]
    return priced_changes.select(
        *[F.col(f"curr.{f}").alias(f) for f in carried],
        *[grown(c).alias(c) for c in TOKEN_COLUMNS], cost.alias("cost_usd"),
        F.lit(1).cast("bigint").alias("events"), F.col("prev").isNotNull().alias("delta"))
