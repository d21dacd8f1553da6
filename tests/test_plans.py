"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from meterline.catalog import QUERIES
from meterline.catalog.inputs import NOW_MS, usage
from meterline.operators import cube, pricing
from meterline.operators.dedup import keep_first
from meterline.operators.scan import Running, chunk_of, ordered_scan

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


BATCH = [n for n in QUERIES if not n.startswith("streamed") and n not in (
    "backfilled_cube", "delivered_alerts", "wall_alerts", "observed_walls", "threshold_alerts_with_wall", "running_pace")]


@pytest.mark.parametrize("name", BATCH)
def test_no_products_of_tables(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_reads_needed_columns_and_pushes_the_time_range(spark):
    df = usage(spark, SF_DIR, NOW_MS - 3_600_000, NOW_MS).groupBy("agent").agg(F.sum("input_tokens"))
    text = plan(df)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"ts", "event_type", "value"}
    assert "GreaterThanOrEqual(ts" in text and "LessThan(ts" in text


def test_cells_take_one_shuffle_and_join_only_the_price_list(spark):
    text = plan(cube.build_cells(usage(spark, SF_DIR), "hour"))
    assert text.count("Exchange hashpartitioning") == 1
    assert text.count("BroadcastHashJoin") == 1 and text.count("Scan parquet") == 1


def test_unread_dimensions_are_neither_read_nor_shuffled(spark):
    text = plan(cube.build_cells(usage(spark, SF_DIR), "hour", keep=("agent",)))
    exchange = re.search(r"Exchange hashpartitioning\(([^\n]*)", text).group(1)
    assert "session_id" not in exchange and "project" not in exchange


def test_a_large_dimension_is_not_broadcast(spark, monkeypatch):
    from meterline.operators import bounded
    monkeypatch.setattr(bounded, "MAX_BROADCAST_ROWS", 3)
    df = usage(spark, SF_DIR)
    small = bounded.broadcast_if_small(pricing.model_rates(df))
    large = bounded.broadcast_if_small(pricing.model_rates(df), max_rows=3)
    assert "ResolvedHint" in small._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in large._jdf.queryExecution().analyzed().toString()


def test_hot_keys_are_cut_before_the_shuffle(spark):
    df = usage(spark, SF_DIR).withColumn("dedup_key", F.lit("one")).withColumn("source_file", F.lit("f")).withColumn(
        "line_start", F.lit(0)).withColumn("line_seq", F.col("event_id"))
    text = plan(keep_first(df))
    assert text.index("WindowGroupLimit") < text.index("Exchange") and text.count("WindowGroupLimit") == 2
    scanned = plan(ordered_scan(df, ["agent"], ["event_id"], chunk_of(F.col("event_id"), 10), t=Running("sum", F.col("k"))))
    windows = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", scanned)
    assert any("agent" in w and "__chunk" in w for w in windows)


BOUNDED = ["top_projects", "history_since", "cube_filter", "today_totals", "this_hour_totals", "range_totals", "range_totals_by_agent",
           "month_rollup", "month_rollup_by_agent", "covered_cost_in_days", "trailing_days", "trailing_hours", "scope_24h", "scope_30d",
           "scope_summary", "scope_agents", "session_traces", "session_means"]


@pytest.mark.parametrize("name", BOUNDED)
def test_time_range_reaches_every_scan(spark, name):
    pushed = re.findall(r"PushedFilters: \[([^\n]*)", plan(entry.queries()[name](spark, SF_DIR)))
    assert pushed and all("GreaterThanOrEqual(ts" in p and "LessThan(ts" in p for p in pushed)


def test_stored_range_prunes_folders(spark, tmp_path):
    cells = cube.build_cells(usage(spark, SF_DIR), "hour")
    for batch in ("b1", "b2"):
        cube.append(cells, str(tmp_path), "hour", batch)
    held = cube.cube_filter(cube.read_tier(spark, str(tmp_path), "hour"), 473600, 473700, tier="hour")
    text = plan(held)
    days = re.search(r"PartitionFilters: \[([^\n]*?)\], PushedFilters", text).group(1)
    assert "part_day" in days and ">= 19733" in days and "<= 19737" in days
    assert held.count() == 2 * cells.where("bucket BETWEEN 473600 AND 473700").count()
