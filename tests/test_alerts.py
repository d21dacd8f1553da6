"""The distributed alert rules against stepping one host after the other, and the stateful stream."""

import random
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from meterline.operators import alerts, quota
from meterline.streaming import state_stream

MIN = 60_000


def observations(n, seed, hosts=(0, 0, 0, 1, 2), shape="random"):
    rng = random.Random(seed)
    rows, now, level = [], 10_000_000, Counter()
    for seq in range(n):
        now += rng.choice([0, 1, 4, 4, 30]) * MIN
        host, agent = rng.choice(hosts), rng.choice(["claude", "codex"])
        kind = rng.choice(["five_hour", "weekly"])
        if shape == "random":
            pct = rng.choice([0, 12, 40, 64, 65, 66, 69, 70, 71, 84, 85, 86, 89.9, 90, 95, 100, 130, -3])
        else:
            level[host, agent, kind] += rng.randrange(0, 9)
            if level[host, agent, kind] > 100 or rng.random() < 0.03:
                level[host, agent, kind] = rng.randrange(0, 40)
            pct = level[host, agent, kind]
        wall = None if rng.random() < 0.3 else (rng.choice(["claude", "codex"]), "weekly",
                                                now + rng.choice([5, 29, 30, 31, 44, 46, 90]) * MIN, float(pct))
        rows.append((host, seq, now, agent, kind, float(pct), now + MIN, *(wall or (None, None, None, None))))
    return rows


SCHEMA = ("host bigint, seq bigint, now_ms bigint, agent string, kind string, used_percent double, "
          "resets_at_ms bigint, wall_agent string, wall_kind string, wall_at_ms bigint, wall_percent double")


def stepped(rows):
    memory, out = {}, set()
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    for row in rows:
        r = SimpleNamespace(**dict(zip(names, row)))
        for a in state_stream.observe(memory.setdefault(r.host, {}), r, alerts.DEFAULT_THRESHOLDS):
            out.add((r.host, a["seq"], a["alert"], a["agent"], a["kind"], a.get("threshold"), a["percent"]))
    return out


def batch(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    walls = df.select("host", "seq", "now_ms", F.col("wall_agent").alias("agent"), F.col("wall_kind").alias("kind"),
                      F.col("wall_percent").alias("used_percent"), "wall_at_ms")
    readings = df.select("host", "seq", "now_ms", "agent", "kind", "used_percent", "resets_at_ms")
    fired = alerts.alerts(readings, walls)
    return {(r["host"], r["seq"], r["alert"], r["agent"], r["kind"], r["threshold"], r["percent"])
            for r in fired.collect()}


@pytest.mark.parametrize("shape,chunk", [("random", 5), ("random", 65_536), ("growing", 16)])
def test_batch_equals_stepping(spark, monkeypatch, shape, chunk):
    monkeypatch.setattr(alerts, "CHUNK_ROWS", chunk)
    rows = observations(400, seed=chunk, shape=shape)
    want = stepped(rows)
    assert len(want) > 20
    assert batch(spark, rows) == want


def stepped_limiter(rows):
    """(host, seq, now, agent, kind, alert, priority) one after the other."""
    last, sent, out = {}, Counter(), set()
    for host, seq, now, agent, kind, alert, priority in sorted(rows, key=lambda r: (r[0], r[1], -r[6], r[3], r[4], r[5])):
        before = last.get((host, agent, alert))
        if sent[host, seq] < alerts.MAX_PER_OBSERVATION and (before is None or now - before >= alerts.RATE_LIMIT_MS):
            last[host, agent, alert] = now
            sent[host, seq] += 1
            out.add((host, seq, agent, kind, alert))
    return out


@pytest.mark.parametrize("chunk,steps", [(2, [0, 1, 4, 6, 30]), (7, [0, 1, 4, 6, 30]), (7, [6]), (5, [0, 1, 4, -25, 9]), (100_000, [0, 1, 4, 6])])
def test_limiter_in_chunks_equals_stepping(spark, chunk, steps):
    """Crowded observations, endless chains of alerts six minutes apart, and a clock that steps back."""
    rng = random.Random(chunk + len(steps))
    rows, now = [], 10_000_000
    for seq in range(60):
        now += rng.choice(steps) * MIN
        for agent in ["claude", "codex", "pi"]:
            for kind in ["five_hour", "weekly"]:
                for alert, priority in (("threshold", 170), ("threshold", 190), ("window_reset", 0)):
                    if rng.random() < 0.35:
                        rows.append((rng.choice([0, 0, 1]), seq, now, agent, kind, alert, priority))
    rows = list({(*r[:6],): r for r in rows}.values())
    frame = spark.createDataFrame(rows, "host bigint, seq bigint, now_ms bigint, agent string, kind string, alert string, priority int")
    got = [(r["host"], r["seq"], r["agent"], r["kind"], r["alert"]) for r in alerts.delivered(frame.repartition(3), chunk).collect()]
    assert len(got) == len(set(got)) and set(got) == stepped_limiter(rows)


def test_limiter_of_nothing(spark):
    empty = spark.createDataFrame([], "host bigint, seq bigint, now_ms bigint, agent string, kind string, alert string, priority int")
    assert alerts.delivered(empty).count() == 0


def test_reset_marks_over_many_chunk_sizes():
    """The summary of a chunk answers for every incoming mark what stepping through it answers."""
    import pandas as pd

    rng = random.Random(9)
    for _ in range(300):
        percent = [float(rng.randrange(0, 101)) for _ in range(rng.randrange(1, 40))]
        rows = pd.DataFrame({"percent": percent})
        summary = alerts._reset_summary(rows)
        for mark in [-1.0, 0.0, 50.0, 69.9, 70.0, 75.0, 85.0, 99.0, 100.0]:
            stepped_mark = mark
            for p in percent:
                if stepped_mark >= 70 and p <= stepped_mark - 30:
                    stepped_mark = p
                else:
                    stepped_mark = max(stepped_mark, p)
            assert alerts._advance_mark(mark, summary) == stepped_mark


def test_first_observation_fires_only_high_tiers(spark):
    low = [(0, 0, 0, "claude", "weekly", 75.0, 0, None, None, None, None)]
    high = [(0, 0, 0, "claude", "weekly", 92.0, 0, None, None, None, None)]
    assert batch(spark, low) == set()
    assert batch(spark, high) == {(0, 0, "threshold", "claude", "weekly", 90, 92.0)}


def test_stream_equals_stepping(spark, tmp_path):
    rows = observations(200, seed=4)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    query = (state_stream.alert_stream(stream).writeStream.format("parquet")
             .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out")))
    query.awaitTermination()
    got = {(r["host"], r["seq"], r["alert"], r["agent"], r["kind"], r["threshold"], r["percent"])
           for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == stepped(rows)


@pytest.mark.parametrize("chunk", [9, 65_536])
def test_stored_alerts_equal_stepping(spark, monkeypatch, tmp_path, chunk):
    """Three micro-batches through the operators of whole tables, from the states that each left."""
    monkeypatch.setattr(alerts, "CHUNK_ROWS", chunk)
    rows = observations(240, seed=6, shape="growing" if chunk == 9 else "random")
    for k in range(3):
        spark.createDataFrame(rows[80 * k:80 * k + 80], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state_stream.stored_alerts(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = [(r["host"], r["seq"], r["alert"], r["agent"], r["kind"], r["threshold"], r["percent"])
           for r in spark.read.parquet(str(tmp_path / "out" / "rows")).collect()]
    assert len(got) == len(set(got)) and set(got) == stepped(rows)


def test_pace_and_wall_goldens(spark):
    """One percent a minute from 50 % puts the wall 35 to 45 minutes after ten minutes."""
    rows = [("claude", "weekly", i, i * MIN, 50.0 + i) for i in range(11)]
    df = spark.createDataFrame(rows, "agent string, kind string, seq bigint, read_at_ms bigint, used_percent double")
    for size in (1, 3, 100):
        paced = quota.pace(df, ["agent", "kind"], F.floor(F.col("seq") / size).cast("bigint"))
        wall = quota.walls(paced, 10 * MIN).first()
        assert 35 * MIN <= wall["wall_at_ms"] - 10 * MIN <= 45 * MIN


def test_pace_goes_on_from_stored_states(spark, monkeypatch, tmp_path):
    """Batches of a stream, each in chunks, against one fold over all."""
    monkeypatch.setattr(quota, "CHUNK_ROWS", 7)
    rng = random.Random(3)
    rows = [(f"h{rng.randrange(3)}", i, i * MIN, float(rng.randrange(0, 101))) for i in range(90)]
    schema = "key string, seq bigint, read_at_ms bigint, used_percent double"
    for k in range(3):
        spark.createDataFrame(rows[30 * k:30 * k + 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state_stream.stored_pace(stream, ["key"], str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r["seq"]: r["pace"] for r in spark.read.parquet(str(tmp_path / "out" / "rows")).collect()}
    want = {r["seq"]: r["pace"] for r in quota.running_pace(spark.createDataFrame(rows, schema), ["key"]).collect()}
    assert len(got) == 90 and got == pytest.approx(want)


@pytest.mark.parametrize("size", [1, 4, 50])
def test_pace_equals_stepping(spark, monkeypatch, size):
    rng = random.Random(size)
    rows = [("h", i, rng.randrange(0, 50) * MIN if rng.random() < 0.2 else i * MIN, float(rng.randrange(0, 101)))
            for i in range(60)]
    df = spark.createDataFrame(rows, "key string, seq bigint, read_at_ms bigint, used_percent double")
    state, want = (-1.0, 0, 0.0), []
    for _, seq, at, pct in rows:
        percent, since, pace = state
        if percent >= 0 and at > since and pct >= percent:
            pace = 0.4 * (pct - percent) / ((at - since) / 60_000) + 0.6 * pace
        state = (pct, at, pace)
        want.append(pace)
    final = quota.pace(df, ["key"], F.floor(F.col("seq") / size).cast("bigint")).first()
    assert final["pace"] == pytest.approx(want[-1]) and final["used_percent"] == rows[-1][3]
    monkeypatch.setattr(quota, "CHUNK_ROWS", size)
    running = {r["seq"]: r["pace"] for r in quota.running_pace(df, ["key"]).collect()}
    assert [running[i] for i in range(60)] == pytest.approx(want)
