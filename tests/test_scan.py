"""Chunked scans, windows and folds against plain loops, with one key holding most rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from meterline.operators.scan import Running, chunk_of, dense, ordered_scan, sliding_sum


def hot_rows(n=600, seed=1):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.7 else f"k{rng.randrange(4)}", i,
             None if rng.random() < 0.4 else rng.randrange(-50, 50)) for i in range(n)]


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_ordered_scan_equals_a_loop(spark, size):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "key string, seq bigint, v bigint")
    got = {r["seq"]: r for r in ordered_scan(
        df, ["key"], ["seq"], chunk_of(F.col("seq"), size),
        last=Running("last", F.col("v")), before=Running("last_before", F.col("v")),
        prev=Running("lag", F.col("v")), total=Running("sum", F.col("v")),
        top=Running("max", F.col("v")), low=Running("min", F.col("v")),
        earlier=Running("max_before", F.col("v")), ahead=Running("sum_before", F.lit(1).cast("bigint"))).collect()}
    state = {}
    for key, seq, v in rows:
        seen = state.setdefault(key, [])
        known = [x for x in seen if x is not None]
        now = known + ([v] if v is not None else [])
        want = (now[-1] if now else None, known[-1] if known else None, seen[-1] if seen else None,
                sum(now) if now else None, max(now, default=None), min(now, default=None),
                max(known, default=None), len(seen) or None)
        row = got[seq]
        assert (row["last"], row["before"], row["prev"], row["total"], row["top"], row["low"], row["earlier"],
                row["ahead"]) == want, (key, seq)
        seen.append(v)


@pytest.mark.parametrize("chunk_len", [5, 20, 1000])
def test_sliding_sum_equals_a_window(spark, chunk_len):
    rng = random.Random(3)
    buckets = sorted(rng.sample(range(400), 150))
    df = spark.createDataFrame([(b, rng.randrange(100)) for b in buckets], "bucket bigint, v bigint")
    plain = df.withColumn("w", F.sum("v").over(Window.partitionBy(F.lit(1)).orderBy("bucket").rangeBetween(-4, 0)))
    got = sliding_sum(df, [], "bucket", 5, ["v"], chunk_len)
    assert {(r["bucket"], r["window_v"]) for r in got.collect()} == {(r["bucket"], r["w"]) for r in plain.collect()}


def test_dense_fills_counters_and_keeps_gauge_gaps(spark):
    df = spark.createDataFrame([("a", 2, 5), ("a", 9, 1)], "k string, bucket bigint, v bigint")
    keys = spark.createDataFrame([("a",), ("b",)], "k string")
    zero = {(r["k"], r["bucket"]): r["v"] for r in dense(df, keys, "bucket", 1, 3, zero=["v"]).collect()}
    assert zero == {("a", 1): 0, ("a", 2): 5, ("a", 3): 0, ("b", 1): 0, ("b", 2): 0, ("b", 3): 0}
    gaps = [r["v"] for r in dense(df.drop("k"), None, "bucket", 1, 3).orderBy("bucket").collect()]
    assert gaps == [None, 5, None]


def file_scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


@pytest.mark.parametrize("name,module", [("dial_scale", "gauges"), ("attributed_growth", "roster"), ("session_states", "roster")])
def test_chained_scans_read_their_source_once(spark, monkeypatch, name, module):
    import importlib

    import __spark_entry__ as entry
    operators = importlib.import_module(f"meterline.operators.{module}")
    read, original = [], operators.settled
    monkeypatch.setattr(operators, "settled", lambda df: read.append(file_scans(df)) or original(df))
    result = entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert read == [1] and file_scans(result) == 0
