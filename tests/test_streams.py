"""Watermarked windows and sessions on small streams."""

import pandas as pd

from meterline.catalog import stream_queries
from meterline.streaming import cube_stream, state_stream

MIN = 60_000
SCHEMA = ("agent string, ts_ms bigint, model string, input_tokens bigint, output_tokens bigint, "
          "cache_creation_tokens bigint, cache_read_tokens bigint, session_id string, project string")


def feed(spark, folder, batches, schema, build):
    """Land one file per batch, drain the stream after each, and return all rows the sink holds."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        stream = spark.readStream.schema(schema).parquet(str(folder / "in"))
        (build(stream).writeStream.format("parquet").option("checkpointLocation", str(folder / "ck"))
         .trigger(availableNow=True).start(str(folder / "out")).awaitTermination())
    return spark.read.parquet(str(folder / "out")).collect()


def event(ts, tokens=10, read=0):
    return ("claude", ts, "m", tokens, 0, 0, read, "s", "/p")


def test_rate_windows_drop_late_rows(spark, tmp_path):
    base = 1_700_000_000_000
    got = feed(spark, tmp_path, [
        [event(base, 10, 95), event(base + 3_000, 5)], [event(base + 60 * MIN)],
        [event(base + 1_000, 999), event(base + 61 * MIN)], [event(base + 200 * MIN)]], SCHEMA, cube_stream.rate_windows)
    tokens = {r["window_start_ms"]: r["tokens"] for r in got}
    assert tokens[base] == 24
    assert tokens[base + 60 * MIN] == 10 and tokens[base + 61 * MIN] == 10


def test_windowed_cells(spark, tmp_path):
    base = 1_700_000_040_000
    got = feed(spark, tmp_path, [[event(base), event(base + 1), event(base + MIN)], [event(base + 9_000 * MIN)]], SCHEMA,
               cube_stream.windowed_cells)
    assert {(r["window_start_ms"], r["input_tokens"], r["events"]) for r in got} == {(base, 20, 2), (base + MIN, 10, 1)}


def test_gauge_windows(spark, tmp_path):
    schema = "host string, metric string, ts_ms bigint, value double"
    base = 1_700_000_000_000
    got = feed(spark, tmp_path, [
        [("h", "cpu", base, 0.1), ("h", "cpu", base + 4_000, 0.9), ("h", "gpu", base, 0.5), ("h", "cpu", base + 11_000, 0.3)],
        [("h", "cpu", base + 100 * MIN, 0.0)]], schema, lambda s: cube_stream.gauge_windows(s, ["cpu"]))
    assert {(r["window_start_ms"] - base, r["metric"], r["value"]) for r in got} == {(0, "cpu", 0.9), (10_000, "cpu", 0.3)}


def test_session_stream_keeps_the_newest_signal(spark, tmp_path):
    schema = "agent string, session_id string, kind string, at_ms bigint, seq bigint"
    got = feed(spark, tmp_path, [
        [("claude", "s", "event", 1000, 1), ("claude", "s", "growth", 5000, 2)], [("claude", "s", "event", 4000, 3)]],
        schema, state_stream.session_stream)
    states = {(r["last_event_ms"], r["last_growth_ms"], r["mid_turn"], r["state"]) for r in got}
    assert states == {(1000, 5000, True, "running"), (4000, 5000, False, "running")}
    assert state_stream.activity(0, 0, False, 1) == "done"
    assert state_stream.activity(1000, 0, False, 1000 + 5 * MIN) == "idle"
    assert state_stream.activity(1000, 1000, True, 1000 + 9 * MIN) == "running"
    assert state_stream.activity(1000, 1000, True, 1000 + 11 * MIN) == "idle"
    assert state_stream.activity(1000, 1000, True, 1001 + 30 * MIN) == "done"


def test_session_updates_come_from_aggregates_alone(spark, tmp_path):
    schema = "agent string, session_id string, kind string, at_ms bigint, seq bigint"
    batches = [[("claude", "s", "event", 1000, 1), ("claude", "s", "growth", 5000, 2), ("codex", None, "growth", 7, 3), ("codex", "t", "event", None, 4)],
               [("claude", "s", "event", 4000, 6), ("claude", "s", None, 3000, 5)], [("codex", None, "growth", 4, 7)]]
    by_mode = {}
    for mode in ("append", "update"):
        where = tmp_path / mode
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(where / "in"))
            updates = state_stream.session_stream(spark.readStream.schema(schema).parquet(str(where / "in")), mode=mode)
            assert ("InPandas" in updates._jdf.queryExecution().analyzed().toString()) == (mode == "append")
            (updates.writeStream.outputMode(mode).option("checkpointLocation", str(where / "ck")).trigger(availableNow=True)
             .foreachBatch(lambda batch, _, to=f"{where}/out/batch={n}": batch.write.mode("overwrite").parquet(to)).start().awaitTermination())
        by_mode[mode] = sorted(map(str, spark.read.parquet(str(where / "out")).collect()))
    assert by_mode["append"] == by_mode["update"] and len(by_mode["update"]) == 5


def test_rows_of_a_key_are_stepped_in_slices(spark):
    seqs = [(7 * n) % 50_021 for n in range(50_021)]
    batches = [pd.DataFrame({"agent": "a", "seq": seqs[at:at + 10_000], "used_percent": [float(s) for s in seqs[at:at + 10_000]], "wall": None})
               for at in range(0, len(seqs), 10_000)]
    slices = list(state_stream._ordered(iter(batches), ["agent"]))
    assert max(map(len, slices)) <= state_stream.SLICE_ROWS < len(seqs) == sum(map(len, slices))
    whole = pd.concat(slices)
    assert whole["seq"].tolist() == sorted(seqs) and (whole["used_percent"] == whole["seq"]).all()
    assert list(whole.columns) == ["seq", "used_percent", "wall"] and whole["wall"].isna().all()


def test_walls_are_computed_once_for_all_batches(spark, tmp_path):
    rows = [(n, n % 4, ("click", "view")[n % 2], 1.0, f'{{"k": {n % 100}}}') for n in range(300)]
    events = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double, props string")
    events.selectExpr("event_id", "CAST(timestamp_seconds(1704067200 + event_id * 60) AS timestamp_ntz) AS ts", "user_id", "event_type", "value", "props").coalesce(
        1).write.parquet(str(tmp_path / "events.parquet"))
    observed = stream_queries._observed(spark, str(tmp_path))
    assert observed.isStreaming and "InPandas" not in observed._jdf.queryExecution().analyzed().toString()
