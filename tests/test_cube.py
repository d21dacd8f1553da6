"""Additivity, replays, late rows, compaction, backfill, change capture and exports."""

import json
import random

import pytest
from pyspark.sql import functions as F

from meterline.functions.timecols import resolve_range
from meterline.operators import cdc, cube, dedup, rates
from meterline.plans import verbs
from meterline.schemas import TOKEN_COLUMNS
from meterline.streaming import cube_stream

HOUR = 3_600_000
SCHEMA = ("agent string, ts_ms bigint, model string, input_tokens bigint, output_tokens bigint, cache_creation_tokens "
          "bigint, cache_read_tokens bigint, session_id string, cwd string, project string, dedup_key string, "
          "source_file string, line_start bigint, line_seq bigint")


def event(i, ts, agent="claude", model="claude-fable-5", tokens=(100, 200, 0, 0), session="s", project="/p", key=None):
    return (agent, ts, model, *tokens, session, project, project, key, "f", 0, i)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def totals(cells):
    r = cube.query(cells, []).first()
    return None if r is None else (r["input_tokens"], r["events"], round(float(r["cost_usd"]), 6))


def test_queries_add_up_and_compaction_changes_nothing(spark):
    rng = random.Random(5)
    rows = [event(i, rng.randrange(10**8), agent=rng.choice(["claude", "goose"]), session=rng.choice("ab"),
                  model=rng.choice(["claude-fable-5", "nope"])) for i in range(200)]
    minute = cube.build_cells(frame(spark, rows), "minute")
    tripled = minute.unionByName(minute).unionByName(minute)
    one, three = totals(minute), totals(tripled)
    assert three == (one[0] * 3, one[1] * 3, pytest.approx(one[2] * 3))
    assert totals(cube.compacted(tripled)) == three
    assert cube.compacted(tripled).count() == minute.count()
    for tier in ("hour", "day"):
        assert totals(cube.coarsen(minute, tier, 330)) == one
    assert totals(minute.limit(0)) is None
    assert cube.query(minute, [], agents=["nobody"]).count() == 0


def test_half_of_all_rows_in_one_cell(spark):
    rows = [event(i, 1000 if i % 2 else i * 60_000) for i in range(1000)]
    cells = cube.build_cells(frame(spark, rows), "minute")
    assert cube.query(cells, ["bucket"], from_bucket=0, to_bucket=0).first()["events"] == 501


def test_stream_appends_late_rows_and_replays_do_not_count_twice(spark, tmp_path):
    source = tmp_path / "in"
    first = [event(i, 10 * HOUR + i * 1000, key=f"k{i}") for i in range(50)]
    frame(spark, first).write.parquet(str(source))

    def run():
        stream = spark.readStream.schema(frame(spark, []).schema).parquet(str(source))
        cube_stream.append_cube(stream, str(tmp_path / "cube"), str(tmp_path / "ck"), keyed=True).awaitTermination()
        return totals(cube.read_tier(spark, str(tmp_path / "cube"), "hour"))

    assert run()[:2] == (5000, 50)
    # A much later file brings a very late row, a row seen before and a new one.
    more = [event(90, HOUR, key="late"), event(91, 10 * HOUR, key="k3"), event(92, 99 * HOUR, key="new"), event(93, 99 * HOUR)]
    frame(spark, more).write.mode("append").parquet(str(source))
    assert run()[:2] == (5300, 53)
    hours = {r["bucket"] for r in cube.read_tier(spark, str(tmp_path / "cube"), "hour").select("bucket").collect()}
    assert hours == {1, 10, 99}
    assert run()[:2] == (5300, 53)
    # The same batch written again replaces its own partitions.
    cells = cube.build_cells(frame(spark, more), "hour")
    cube.append(cells, str(tmp_path / "again"), "hour", "b1")
    cube.append(cells, str(tmp_path / "again"), "hour", "b1")
    assert totals(cube.read_tier(spark, str(tmp_path / "again"), "hour"))[1] == 4
    assert cube.compact(spark, str(tmp_path / "cube"), "hour", force=True)
    assert totals(cube.read_tier(spark, str(tmp_path / "cube"), "hour"))[:2] == (5300, 53)


def batches(spark, path, tier="hour"):
    return {r["batch_id"] for r in cube.read_tier(spark, path, tier).select("batch_id").distinct().collect()}


def test_compaction_takes_effect_at_once_and_batches_go_on(spark, tmp_path):
    path = str(tmp_path)
    for n in range(3):
        cube.append(cube.build_cells(frame(spark, [event(i, i * HOUR) for i in range(20)]), "hour"), path, "hour", f"b{n}")
    whole = totals(cube.read_tier(spark, path, "hour"))
    assert cube.compact(spark, path, "hour")  # two of three rows repeat a key
    cells = cube.read_tier(spark, path, "hour")
    assert totals(cells) == whole and cells.count() == 20 and batches(spark, path) == {"compacted-000001"}
    # A batch that was replaced is replayed: it still counts once. A new one counts.
    cube.append(cube.build_cells(frame(spark, [event(i, i * HOUR) for i in range(20)]), "hour"), path, "hour", "b2")
    assert totals(cube.read_tier(spark, path, "hour")) == whole
    cube.append(cube.build_cells(frame(spark, [event(7, 500 * HOUR)]), "hour"), path, "hour", "b3")
    assert totals(cube.read_tier(spark, path, "hour"))[1] == whole[1] + 1
    assert batches(spark, path) == {"compacted-000001", "b3"}
    # A copy that no manifest names does not count: the compaction broke off before its last step.
    cube.append(cube.build_cells(frame(spark, [event(9, 900 * HOUR)]), "hour"), path, "hour", "compacted-000002")
    assert totals(cube.read_tier(spark, path, "hour"))[1] == whole[1] + 1
    assert not cube.compact(spark, path, "hour")
    assert cube.compact(spark, path, "hour", force=True)
    assert batches(spark, path) == {"compacted-000002"} and totals(cube.read_tier(spark, path, "hour"))[1] == whole[1] + 1
    before = cube.file_statistics(spark, path, ("hour",)).first()
    on_disk = len(list(tmp_path.glob("hour/part_day=*/batch_id=*")))
    gone = cube.clear_replaced(spark, path, "hour")
    left = list(tmp_path.glob("hour/part_day=*/batch_id=*"))
    assert gone == on_disk - len(left) > 0 and {p.name for p in left} == {"batch_id=compacted-000002"}
    assert totals(cube.read_tier(spark, path, "hour"))[1] == whole[1] + 1
    after = cube.file_statistics(spark, path, ("hour",)).first()
    assert after == before and after["bytes"] == sum(f.stat().st_size for f in tmp_path.glob("hour/**/*.parquet"))
    assert cube.clear_replaced(spark, path, "hour") == 0 and batches(spark, path) == {"compacted-000002"}


def test_extent_and_summary_of_a_store_with_bytes(spark, tmp_path):
    path = str(tmp_path)
    minute = cube.build_cells(frame(spark, [event(i, i * HOUR) for i in range(30)]), "minute")
    for tier, cells in (("minute", minute), ("hour", cube.coarsen(minute, "hour")), ("day", cube.coarsen(minute, "day"))):
        cube.append(cells, path, tier, "b0")
    rows = {r["tier"]: r for r in cube.stored_extent(spark, path).collect()}
    for tier, r in rows.items():
        files = list(tmp_path.glob(f"{tier}/**/*.parquet"))
        assert (r["files"], r["bytes"]) == (len(files), sum(f.stat().st_size for f in files))
    tiers = [cube.read_tier(spark, path, t) for t in ("minute", "hour", "day")]
    summary = cube.store_summary(*tiers, cube.file_statistics(spark, path)).first()
    assert summary["bytes"] == sum(r["bytes"] for r in rows.values()) and summary["records"] == sum(r["records"] for r in rows.values())


def test_backfill_runs_once(spark, tmp_path):
    rows = frame(spark, [event(i, i * HOUR) for i in range(30)])
    assert cube_stream.backfill_once(spark, rows, str(tmp_path), "g1")
    assert not cube_stream.backfill_once(spark, rows, str(tmp_path), "g1")
    assert totals(cube.read_tier(spark, str(tmp_path), "day"))[1] == 30
    hot = cube_stream.prune_hot(spark, str(tmp_path), 60 * HOUR)
    assert hot.count() == 18


def test_keep_first_with_a_hot_key(spark):
    rows = [event(i, i, key="hot" if i % 3 else (None if i % 2 else f"k{i}")) for i in range(300)]
    kept = dedup.keep_first(frame(spark, rows)).collect()
    assert sorted(r["line_seq"] for r in kept) == sorted([1] + [i for i in range(300) if i % 3 == 0])
    plan = dedup.keep_first(frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    stored = spark.createDataFrame([("claude", "hot"), ("codex", "k0")], "agent string, dedup_key string")
    fresh = dedup.not_yet_stored(frame(spark, rows), stored)
    assert fresh.count() == 100 and fresh.columns == frame(spark, rows).columns


def test_changes_are_exact_on_totals_and_additive_in_the_cube(spark):
    fields = ("project", "ts_ms", "model", *TOKEN_COLUMNS, "cost_usd")
    kind = ("key string, project string, ts_ms bigint, model string, input_tokens bigint, output_tokens bigint, "
            "cache_creation_tokens bigint, cache_read_tokens bigint, cost_usd decimal(38,12)")

    def version(*rows):
        return spark.createDataFrame(rows, "key string, project string, ts_ms bigint, model string, input_tokens bigint, "
                                           "output_tokens bigint, cache_creation_tokens bigint, cache_read_tokens bigint, "
                                           "cost_usd double").select(*[F.col(f.split()[0]).cast(f.split(" ")[1])
                                                                       for f in kind.split(", ")])

    old = version(("a", "/p", 1, "m", 10, 5, 0, 0, 1.0), ("b", "/p", 1, "m", 7, 7, 0, 0, None), ("c", "/q", 1, "m", 1, 1, 0, 0, 2.0))
    new = version(("a", "/p", 1, "m", 4, 9, 0, 0, 0.5), ("b", "/p", 1, "m", 7, 7, 0, 0, None), ("d", "/q", 2, "m", 3, 0, 0, 0, 0.25))
    found = cdc.changes(old, new, ["key"], fields)
    assert {(r["key"], r["op"]) for r in found.collect()} == {("a", "replace"), ("d", "add")}
    base = spark.createDataFrame([("/p", 17, 12, 0, 0, 2, "1"), ("/q", 1, 1, 0, 0, 1, "2")],
                                 "project string, input_tokens bigint, output_tokens bigint, cache_creation_tokens bigint, "
                                 "cache_read_tokens bigint, events bigint, cost_usd string").withColumn(
        "cost_usd", F.col("cost_usd").cast("decimal(38,12)"))
    exact = {r["project"]: (r["input_tokens"], r["output_tokens"], r["events"], float(r["cost_usd"]))
             for r in cdc.applied(base, found, ["project"]).collect()}
    assert exact == {"/p": (11, 16, 2, 0.5), "/q": (4, 1, 2, 2.25)}
    deltas = {r["ts_ms"]: (r["input_tokens"], r["output_tokens"], float(r["cost_usd"]), r["events"], r["delta"])
              for r in cdc.delta_events(found).collect()}
    assert deltas == {1: (0, 4, -0.5, 1, True), 2: (3, 0, 0.25, 1, False)}
    merged = {r["key"]: r["input_tokens"] for r in cdc.merged(old, new, ["key"]).collect()}
    assert merged == {"a": 4, "b": 7, "c": 1, "d": 3}


def test_burn_equals_a_ring(spark):
    """The decayed rate is the one of a 15-slot ring fed in any order."""
    rng = random.Random(11)
    now = 1_000 * 60_000 + 12_345
    rows = [event(i, now - rng.randrange(0, 25 * 60_000), tokens=(rng.randrange(500), 0, 0, rng.randrange(99))) for i in range(80)]
    want = sum((t[3] + t[6] // 10) * 2 ** (-(now // 60_000 - t[1] // 60_000) / 4) for t in rows
               if now // 60_000 - t[1] // 60_000 < 15) / sum(2 ** (-k / 4) for k in range(15))
    df = frame(spark, rows)
    assert rates.burn_rate(df, now).first()[0] == pytest.approx(want)
    assert rates.burn_by_agent(df, now).first()["tokens_per_min"] == pytest.approx(want)
    assert rates.burn_rate(df, now + 60 * 60_000).first()[0] == 0.0
    assert rates.hottest(rates.burn_by_agent(df, now + 60 * 60_000)).count() == 0


def test_exports(spark, tmp_path):
    rows = [event(0, HOUR, project='/p,"x"'), event(1, HOUR, project="/t\tb\\c\nd")]
    out = verbs.export(cube.build_cells(frame(spark, rows), "hour"))
    verbs.write_csv(out, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))
    assert ('bucket_ms,agent,model,project,session,input,output,cache_creation,cache_read,cost_usd,events,covered,synthetic'
            in text)
    assert '3600000,claude,claude-fable-5,"/p,""x""",s,100,200,0,0,0.011000,1,0.011000,0' in text
    assert any("\t/t\\tb\\\\c\\nd\t" in r["value"] for r in verbs.tsv_line(out).collect())
    span = resolve_range("hour", 5 * HOUR, "4h")
    found, note = verbs.history(cube.build_cells(frame(spark, rows), "hour"), ["agent"], span=span)
    lines = [json.loads(r["value"]) for r in verbs.json_rows(found, "history", span).collect()]
    assert note is None and lines[0]["query"] == {
        "bucket": "hour", "time_basis": "utc", "tz_offset_min": 0, "since_ms": HOUR, "until_ms": 6 * HOUR - 1,
        "from_bucket": 1, "to_bucket": 5}
    assert lines[1]["agent"] == "claude" and lines[1]["tokens"] == 600 and lines[1]["cost_usd"] == 0.022
    empty, note = verbs.history(cube.build_cells(frame(spark, rows), "hour"), ["agent"], model="gpt-9")
    assert empty.count() == 0 and note == 'no model named "gpt-9" in this store'
