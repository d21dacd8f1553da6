"""Stored dedup keys that are looked up without being read whole.

Keys lie in folders of (bucket, generation), the bucket by a hash of agent and key. Beside them
each (bucket, generation) has a bitmap of hash positions, a Bloom filter of one hash. A look-up computes the
positions of its own keys, keeps the (bucket, generation) pairs whose bitmap holds one of them, and reads
only those folders; the plan names them as partition filters. A pair that a bitmap lets through by chance is read for nothing,
never the other way round.

A key that was stored for a third of all events is one row. A generation that is written again replaces its own folders.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.session import drop_folder

BUCKETS = 256
#: Bits of the bitmap that Spark builds.
BITS = 32_768
KEYS = "agent string, dedup_key string, bucket int, generation int"
FILTERS = "bits binary, bucket int, generation int"


def _hash() -> Column:
    return F.xxhash64("agent", "dedup_key")


def _placed(keys: DataFrame, buckets: int) -> DataFrame:
    """With the key's bucket, and its position in the bitmap by other bits of the same hash."""
    return keys.withColumns({"bucket": F.pmod(_hash(), F.lit(buckets)).cast("int"),
                             "position": F.pmod(F.shiftrightunsigned(_hash(), 24), F.lit(BITS))})


def add(events: DataFrame, path: str, generation: int, buckets: int = BUCKETS) -> None:
    """Store the keys of new events; the filters last, so a key without a filter belongs to a run that broke off."""
    keys = _placed(events.filter(F.col("dedup_key").isNotNull()).select("agent", "dedup_key"), buckets)
    for folder in ("rows", "filters"):
        drop_folder(events.sparkSession, f"{path}/{folder}/generation={generation}")
    tagged = keys.withColumn("generation", F.lit(generation))
    (tagged.select("agent", "dedup_key", "generation", "bucket").repartition("bucket").write.mode("append")
     .partitionBy("generation", "bucket").parquet(f"{path}/rows"))
    bits = keys.groupBy("bucket").agg(F.bitmap_construct_agg("position").alias("bits"))
    (bits.withColumn("generation", F.lit(generation)).select("bits", "bucket", "generation").coalesce(1).write.mode("append")
     .partitionBy("generation").parquet(f"{path}/filters"))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def hits(spark: SparkSession, path: str, events: DataFrame, generation: int, buckets: int = BUCKETS) -> list[tuple[int, int]]:
    """The (generation, bucket) pairs of other generations that may hold a key of `events`; at most the folders there are."""
    filters = _read(spark, f"{path}/filters", FILTERS)
    if filters is None:
        return []
    asked = _placed(events.filter(F.col("dedup_key").isNotNull()).select("agent", "dedup_key"), buckets).select(
        "bucket", "position").distinct()
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.shiftright("position", 3).cast("int") + 1, 1)), 16, 10).cast("int")
    found = filters.filter(F.col("generation") != generation).join(asked, "bucket").filter(
        F.getbit(byte, (F.col("position") % 8).cast("int")) == 1)
    return sorted((r["generation"], r["bucket"]) for r in found.select("generation", "bucket").distinct().collect())


def matching(spark: SparkSession, path: str, events: DataFrame, generation: int, buckets: int = BUCKETS) -> DataFrame:
    """The stored keys (agent, dedup_key) of the folders that may hold a key of `events`."""
    pairs = hits(spark, path, events, generation, buckets)
    rows = _read(spark, f"{path}/rows", KEYS) if pairs else None
    if rows is None:
        return spark.createDataFrame([], "agent string, dedup_key string")
    of: dict[int, list[int]] = {}
    for g, b in pairs:
        of.setdefault(g, []).append(b)
    chosen = F.lit(False)
    for g, bs in of.items():
        chosen = chosen | ((F.col("generation") == g) & F.col("bucket").isin(bs))
    return rows.filter(chosen).select("agent", "dedup_key")
