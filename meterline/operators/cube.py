"""The additive usage cube: build, append, query, compact, inspect (A1-A5, A13-A15, F1, F2, F4, SNK1)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions import timecols
from meterline.functions.money import COST
from meterline.operators.pricing import price
from meterline.operators.scan import union_all
from meterline.schemas import COVERED_AGENTS, DIMENSIONS, KNOWN_AGENTS, TOKEN_COLUMNS
from meterline.session import drop_folder, drop_matching, folder_exists

KEY = ("bucket", *DIMENSIONS, "covered", "delta", "synthetic", "tz_offset_min")
MEASURES = (*TOKEN_COLUMNS, "events", "cost_usd")
STORED = ", ".join([
    "bucket bigint", *(f"{d} string" for d in DIMENSIONS), "covered boolean, delta boolean, synthetic boolean", "tz_offset_min int",
    *(f"{c} bigint" for c in TOKEN_COLUMNS), f"events bigint, cost_usd {COST}, part_day bigint, batch_id string"])
COMPACTED = "compacted-"
COMPACT_DUP_RATIO = 0.25
COMPACT_BYTES = 32 * 1024 * 1024


def sums(columns: tuple[str, ...] = MEASURES) -> list[Column]:
    return [F.sum(c).cast(COST if c.endswith("cost_usd") else "bigint").alias(c) for c in columns]


def covered_flag(agent: Column) -> Column:
    """Subscription agents, unless the row says otherwise."""
    return agent.isin(*COVERED_AGENTS)


def build_cells(events: DataFrame, tier: str = "minute", tz_offset_min: int = 0,
                prices: DataFrame | None = None, rates: DataFrame | None = None,
                keep: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Usage events -> cube cells of one tier.

    One shuffle: tokens are summed per cell (map-side first) and the cells, which
    keep the model, are priced afterwards - exact, and far fewer rows to price.
    A query that needs few dimensions names them in `keep`; the others are blank
    and neither read nor shuffled.
    """
    kept = [d for d in DIMENSIONS if d in keep or d == "model"]
    columns = set(events.columns)
    flags = {
        "covered": F.col("covered") if "covered" in columns else covered_flag(F.col("agent")),
        "delta": F.col("delta") if "delta" in columns else F.lit(False),
        "synthetic": F.col("synthetic") if "synthetic" in columns else F.lit(False),
    }
    keyed = events.withColumns({
        "bucket": timecols.tier_bucket(tier, F.col("ts_ms"), tz_offset_min),
        "tz_offset_min": F.lit(tz_offset_min if tier == "day" else 0), **flags})
    priced_already = "cost_usd" in columns
    cells = keyed.groupBy(*[k for k in KEY if k not in DIMENSIONS or k in kept]).agg(
        *sums(TOKEN_COLUMNS),
        (F.sum("events").cast("bigint") if "events" in columns else F.count("*")).alias("events"),
        *(sums(("cost_usd",)) if priced_already else []))
    if not priced_already:
        cells = price(cells, prices, rates)
    return cells.withColumn("cost_usd", F.coalesce("cost_usd", F.lit(0).cast(COST))).withColumns(
        {d: F.lit("") for d in DIMENSIONS if d not in kept}).select(*KEY, *MEASURES)


def coarsen(cells: DataFrame, tier: str, tz_offset_min: int = 0) -> DataFrame:
    """Minute cells -> hour or day cells: aggregates partial sums, never re-reads events."""
    start = timecols.bucket_start_ms("minute", F.col("bucket"))
    return (cells.withColumn("bucket", timecols.tier_bucket(tier, start, tz_offset_min))
            .withColumn("tz_offset_min", F.lit(tz_offset_min if tier == "day" else 0))
            .groupBy(*KEY).agg(*sums()))


def hot_only(cells: DataFrame, now_ms: int) -> DataFrame:
    """Minute cells young enough for the hot tier (48 h)."""
    return cells.filter(timecols.bucket_start_ms("minute", F.col("bucket"))
                        >= now_ms - timecols.HOT_MAX_AGE_MS)


def with_partition_day(cells: DataFrame, tier: str) -> DataFrame:
    """UTC date of the bucket start: the partition column of the stored tiers."""
    if tier == "day":
        return cells.withColumn("part_day", F.col("bucket"))
    per_day = 1440 if tier == "minute" else 24
    return cells.withColumn("part_day", timecols.floor_div(F.col("bucket"), per_day))


def append(cells: DataFrame, path: str, tier: str, batch_id: str) -> None:
    """Append cells of one batch. Readers sum repeated keys, so late rows just land.

    Appends are not idempotent, so a batch owns the `batch_id` partitions it wrote
    and replaces them when it is replayed.
    """
    rows = with_partition_day(cells, tier).withColumn("batch_id", F.lit(batch_id))
    # Files of a useful size: small days share a task, a hot day is split over several.
    # Days first: a filter on days lists the folders of those days alone, whatever the number of batches.
    (rows.hint("rebalance", "part_day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("part_day", "batch_id").parquet(f"{path}/{tier}"))


@dataclass(frozen=True)
class Manifest:
    """Which folders of a tier count: compacted ones that are live, and the batches that they replace."""

    version: int = 0
    live: tuple[str, ...] = ()
    replaced: tuple[str, ...] = ()

    @classmethod
    def read(cls, spark, path: str, tier: str) -> Manifest:
        if not folder_exists(spark, f"{path}/live/{tier}"):
            return cls()
        rows = spark.read.schema("batch_id string, live boolean, version int").parquet(f"{path}/live/{tier}")
        # A row per batch that is not yet cleared away.
        rows = rows.filter(F.col("version") == rows.agg(F.max("version")).scalar()).collect()
        names = lambda live: tuple(sorted(r["batch_id"] for r in rows if r["live"] == live))
        return cls(rows[0]["version"], names(True), names(False)) if rows else cls()

    def write(self, spark, path: str, tier: str) -> None:
        """One file that appears whole, under a version that readers take as soon as it is there."""
        rows = [(b, True) for b in self.live] + [(b, False) for b in self.replaced]
        spark.createDataFrame(rows, "batch_id string, live boolean").coalesce(1).write.mode("overwrite").parquet(
            f"{path}/live/{tier}/version={self.version}")

    def counts(self, batch: Column) -> Column:
        """A compacted folder that no manifest names is one that broke off, or is being written."""
        return ~batch.isin(*self.replaced) & (~batch.startswith(COMPACTED) | batch.isin(*self.live))


def read_tier(spark, path: str, tier: str) -> DataFrame:
    """All cells of one tier that its manifest counts, unsorted; filters on `part_day` prune folders. No file is opened for a schema."""
    return spark.read.schema(STORED).parquet(f"{path}/{tier}").filter(Manifest.read(spark, path, tier).counts(F.col("batch_id")))


def file_statistics(spark, path: str, tiers: tuple[str, ...] = ("minute", "hour", "day")) -> DataFrame:
    """Per tier the files that its manifest counts and their bytes, from a listing; no file is opened."""
    parts = []
    for tier in tiers:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
            "pathGlobFilter", "*.parquet").load(f"{path}/{tier}")
        batch = F.regexp_extract("path", "/batch_id=([^/]*)/", 1)
        counted = files.filter(Manifest.read(spark, path, tier).counts(batch))
        parts.append(counted.agg(F.lit(tier).alias("tier"), F.count(F.lit(1)).alias("files"),
                                 F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("bytes")))
    return union_all(parts)


def cube_filter(cells: DataFrame, from_bucket: int = 0, to_bucket: int = timecols.MAX_BUCKET,
                agents: list[str] | None = None, model: str | None = None, project: str | None = None,
                session: str | None = None, covered_only: bool = False, tier: str | None = None) -> DataFrame:
    """Inclusive bucket range and exact names; a set of agents holds known agents only.

    The defaults do not bound the range. Cells of a stored tier are bounded by `part_day` too, so
    folders outside the range are not listed.
    """
    tests = [F.lit(True)]
    stored = tier and "part_day" in cells.columns
    per_day = {"minute": 1440, "hour": 24, "day": 1}.get(tier, 1)
    if from_bucket > 0:
        tests.append(F.col("bucket") >= from_bucket)
        tests += [F.col("part_day") >= from_bucket // per_day] if stored else []
    if to_bucket < timecols.MAX_BUCKET:
        tests.append(F.col("bucket") <= to_bucket)
        tests += [F.col("part_day") <= to_bucket // per_day] if stored else []
    if agents is not None:
        tests.append(F.col("agent").isin([a for a in agents if a in KNOWN_AGENTS]))
        tests.append(~F.col("synthetic"))
    for column, wanted in (("model", model), ("project", project), ("session_id", session)):
        if wanted:
            tests.append(F.col(column) == wanted)
    if covered_only:
        tests.append(F.col("covered"))
    return cells.filter(reduce(lambda a, b: a & b, tests))


def unknown_name_note(cells: DataFrame, kind: str, name: str) -> str | None:
    """A name this cube never saw is a stop with a note, not a filter that matches nothing."""
    column = {"model": "model", "project": "project", "session": "session_id"}[kind]
    if cells.filter(F.col(column) == name).isEmpty():
        return f'no {kind} named "{name}" in this store'
    return None


def query(cells: DataFrame, group_by: list[str], **filters) -> DataFrame:
    """Filter, then group by any subset of bucket and the four dimensions.

    No matching cell means no row, also without grouping columns.
    """
    hits = cube_filter(cells, **filters)
    grouped = hits.groupBy(*group_by).agg(
        *sums(),
        F.sum(F.when(F.col("covered"), F.col("cost_usd")).otherwise(F.lit(0).cast(COST)))
        .cast(COST).alias("covered_cost_usd"),
        F.count("*").alias("records"))
    return grouped if group_by else grouped.filter(F.col("records") > 0)


def series(cells: DataFrame, group_by: list[str] = (), **filters) -> DataFrame:
    """`query` with the bucket forced in; absent buckets stay absent."""
    return query(cells, ["bucket", *[g for g in group_by if g != "bucket"]], **filters)


def duplicate_ratio(cells: DataFrame) -> DataFrame:
    """Rows, distinct keys and the share of repeated keys."""
    return (cells.groupBy(*KEY).agg(F.count("*").alias("n"))
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("keys"))
            .select("rows", "keys", F.when(F.col("rows") > 0, (F.col("rows") - F.col("keys"))
                                           / F.col("rows")).otherwise(F.lit(0.0)).alias("duplicate_ratio")))


def compacted(cells: DataFrame) -> DataFrame:
    """One row per full key, flags included; every query answers the same before and after."""
    return cells.groupBy(*KEY).agg(*sums())


def compact(spark, path: str, tier: str, force: bool = False, dup_ratio: float = COMPACT_DUP_RATIO,
            min_bytes: int = COMPACT_BYTES) -> bool:
    """Replace the batches of a tier by one compacted copy when its size or its repeats call for it.

    The size is that of the listed files and costs no read; only below `min_bytes` are repeats counted. The copy is
    a batch like any other; the manifest, written last, makes it count and those it was made of not, at once. Batches that land
    meanwhile count as before, and a batch that is replayed later still does not. The replaced folders stay for
    readers that began before, until `clear_replaced`.
    """
    now = Manifest.read(spark, path, tier)
    cells = read_tier(spark, path, tier)
    if not force and (file_statistics(spark, path, (tier,)).first()["bytes"] or 0) < min_bytes:
        if duplicate_ratio(cells).first()["duplicate_ratio"] <= dup_ratio:
            return False
    batches = sorted(r["batch_id"] for r in cells.select("batch_id").distinct().collect())
    tag = f"{COMPACTED}{now.version + 1:06d}"
    drop_matching(spark, f"{path}/{tier}/part_day=*/batch_id={tag}")  # of a run that broke off
    append(compacted(cells.filter(F.col("batch_id").isin(batches))), path, tier, tag)
    Manifest(now.version + 1, (tag,), tuple(sorted({*batches, *now.replaced}))).write(spark, path, tier)
    return True


def clear_replaced(spark, path: str, tier: str) -> int:
    """Remove the folders that no reader counts any more; how many. A batch that is gone must not be replayed."""
    now = Manifest.read(spark, path, tier)
    gone = sum(drop_matching(spark, f"{path}/{tier}/part_day=*/batch_id={b}") for b in now.replaced)
    if now.version:
        Manifest(now.version + 1, now.live).write(spark, path, tier)
        for version in range(max(0, now.version - 1), now.version + 1):
            drop_folder(spark, f"{path}/live/{tier}/version={version}")
    return gone


def extent(tiers: dict[str, DataFrame]) -> DataFrame:
    """Per tier: rows, first and last bucket with their instants, offset."""
    parts = []
    for tier, cells in tiers.items():
        offset = F.max("tz_offset_min")
        step = {"minute": timecols.MINUTE_MS, "hour": timecols.HOUR_MS, "day": timecols.DAY_MS}[tier]
        parts.append(cells.agg(
            F.lit(tier).alias("tier"), F.count("*").alias("records"),
            F.min("bucket").alias("first_bucket"), F.max("bucket").alias("last_bucket"),
            (F.min("bucket") * step - F.coalesce(offset, F.lit(0)) * 60_000).alias("first_ms"),
            (F.max("bucket") * step - F.coalesce(offset, F.lit(0)) * 60_000).alias("last_ms"),
            F.coalesce(offset, F.lit(0)).cast("bigint").alias("tz_offset_min"),
            F.lit("local" if tier == "day" else "utc").alias("time_basis")))
    return union_all(parts)


def stored_extent(spark, path: str) -> DataFrame:
    """`extent` of the stored tiers with their files and bytes."""
    tiers = {t: read_tier(spark, path, t) for t in ("minute", "hour", "day")}
    return extent(tiers).join(F.broadcast(file_statistics(spark, path)), "tier")  # three rows each


def store_summary(minute: DataFrame, hour: DataFrame, day: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Rows over all tiers, first and last instant, distinct hot minutes; with `file_statistics` the bytes too."""
    minutes = minute.select("bucket").distinct().agg(F.count("*").alias("hot_minutes"))
    total = extent({"minute": minute, "hour": hour, "day": day}).agg(
        F.sum("records").cast("bigint").alias("records"),
        F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"))
    total = total.withColumn("hot_minutes", minutes.scalar())
    return total.withColumn("bytes", files.agg(F.sum("bytes")).scalar()) if files is not None else total


def invalid_cell() -> Column:
    """A stored row no writer of ours could have produced."""
    negative = reduce(lambda a, b: a | b, [F.col(c) < 0 for c in (*TOKEN_COLUMNS, "events")])
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in ("bucket", *DIMENSIONS)])
    return F.coalesce(missing | negative | ((F.col("cost_usd") < 0) & ~F.col("delta")), F.lit(True))


def health(tiers: dict[str, DataFrame]) -> DataFrame:
    """Per tier: rows, valid and unreadable rows, bucket extent of the valid ones."""
    parts = []
    for tier, cells in tiers.items():
        valid = ~invalid_cell()
        parts.append(cells.agg(
            F.lit(tier).alias("tier"), F.count("*").alias("slots"),
            F.count_if(valid).alias("valid_records"), F.count_if(~valid).alias("unreadable_slots"),
            F.min(F.when(valid, F.col("bucket"))).alias("first_bucket"),
            F.max(F.when(valid, F.col("bucket"))).alias("last_bucket")))
    return union_all(parts)


def dangling_references(coded: DataFrame, names: DataFrame, id_column: str) -> DataFrame:
    """References to ids the dictionary does not hold: distinct ids and rows."""
    used = coded.filter(F.col(id_column) != 0).groupBy(id_column).agg(F.count("*").alias("rows"))
    return used.join(names.select(F.col("id").alias(id_column)), id_column, "left_anti").select(
        F.concat(F.lit("?id:"), F.col(id_column).cast("string")).alias("reference"), "rows")


def named(coded: DataFrame, names: DataFrame, id_column: str, name_column: str) -> DataFrame:
    """Dictionary-coded ids -> names; id 0 is '', a missing name becomes `?id:<n>`, rows are kept."""
    lookup = names.select(F.col("id").alias(id_column), F.col("name").alias("__name"))
    return coded.join(lookup, id_column, "left").withColumn(
        name_column, F.when(F.col(id_column) == 0, F.lit("")).otherwise(F.coalesce(
            "__name", F.concat(F.lit("?id:"), F.col(id_column).cast("string"))))).drop("__name")


def agent_named(coded: DataFrame, agents: DataFrame) -> DataFrame:
    """Agent ids -> labels; 255 is `synthetic`, an unknown id keeps its row as `agent-<n>`."""
    lookup = agents.select("agent_id", F.col("agent").alias("__label"))
    return coded.join(F.broadcast(lookup), "agent_id", "left").withColumn(
        "agent", F.when(F.col("agent_id") == 255, F.lit("synthetic")).when(
            F.col("agent_id") == 0, F.lit("")).otherwise(F.coalesce(
                "__label", F.concat(F.lit("agent-"), F.col("agent_id").cast("string"))))).drop("__label")
