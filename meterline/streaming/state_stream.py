"""Stateful streams: quota pace, session activity, alerts (ST4-ST6, ST9, ST14-ST17).

State per key is a handful of numbers. `pace_stream` and `alert_stream` put the rows of a key inside one micro-batch in
arrival order before they step the state, as Arrow columns of which a slice at a time becomes rows; the source's rate options
(maxFilesPerTrigger, maxBytesPerTrigger) bound what that can be. `stored_pace` and `stored_alerts` fold a micro-batch in chunks from states in tables, so a key's batch is many
tasks, for more jobs per batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from meterline.operators import alerts as rules
from meterline.operators.quota import ALPHA, resumed_pace
from meterline.operators.roster import DONE_AFTER_MS, MID_TURN_MS, RUNNING_WITHIN_MS, activity_of
from meterline.session import drop_folder, settled

#: Rows of a key that are Python objects at a time.
SLICE_ROWS = 16_384


def _ordered(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of a key in arrival order, without the key, in slices: what is held are Arrow columns, a few bytes a value."""
    rows = pa.concat_tables((pa.Table.from_pandas(b.drop(columns=keys), preserve_index=False) for b in batches),
                            promote_options="permissive").combine_chunks()
    order = pc.sort_indices(rows["seq"])
    for at in range(0, len(order), SLICE_ROWS):
        yield rows.take(order.slice(at, SLICE_ROWS)).to_pandas()


def pace_stream(readings: DataFrame) -> DataFrame:
    """The smoothed pace after every reading of (agent, kind)."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        percent, at, pace = state.get if state.exists else (-1.0, 0, 0.0)
        for rows in _ordered(batches, ["agent", "kind"]):
            out = []
            for row in rows.itertuples():
                if percent >= 0 and row.read_at_ms > at and row.used_percent >= percent:
                    slope = (row.used_percent - percent) / ((row.read_at_ms - at) / 60_000.0)
                    pace = ALPHA * slope + (1 - ALPHA) * pace
                percent, at = float(row.used_percent), int(row.read_at_ms)
                out.append((*key, row.seq, at, percent, pace))
            yield pd.DataFrame(out, columns=["agent", "kind", "seq", "read_at_ms", "used_percent", "pace"])
        state.update((percent, at, float(pace)))

    return readings.select("agent", "kind", "seq", "read_at_ms", "used_percent").groupBy(
        "agent", "kind").applyInPandasWithState(
        step, "agent string, kind string, seq bigint, read_at_ms bigint, used_percent double, pace double",
        "percent double, at bigint, pace double", "append", GroupStateTimeout.NoTimeout)


def stored_pace(readings: DataFrame, keys: list[str], path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """The pace after every reading, with the state of the keys in a table: for keys whose micro-batch is too much for one task.

    A micro-batch is folded in chunks like a whole table, from the states that the batch before it stored. A batch owns
    its rows and its states and overwrites both when it is replayed; states are written last.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = ", ".join(f"{k} {batch.schema[k].dataType.simpleString()}" for k in keys) + ", state string"
        paced, after = resumed_pace(batch, keys, _stored(spark, path, "state", batch_id, schema))
        paced.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        after.write.mode("overwrite").parquet(f"{path}/state/batch={batch_id}")
        drop_folder(spark, f"{path}/state/batch={batch_id - 2}")

    return (readings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def _stored(spark: SparkSession, path: str, name: str, batch_id: int, schema: str) -> DataFrame:
    """A state table as the batch before `batch_id` left it."""
    if not batch_id:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{name}/batch={batch_id - 1}")


def stored_alerts(observations: DataFrame, path: str, checkpoint: str, thresholds: tuple[int, ...] = rules.DEFAULT_THRESHOLDS,
                  trigger: dict | None = None) -> StreamingQuery:
    """Delivered alerts, with the state of the hosts in tables: for hosts whose micro-batch is too much for one task.

    A micro-batch goes through the operators of a whole table, from what the batch before it stored: the readings and walls that
    speak for later ones, the high-water marks, and what went out last. `seq` grows from batch to batch. States are
    written last, and a batch that is replayed overwrites its own.
    """
    reading = "host bigint, seq bigint, now_ms bigint, agent string, kind string, used_percent double, resets_at_ms bigint"
    wall = "host bigint, seq bigint, now_ms bigint, agent string, kind string, used_percent double, wall_at_ms bigint"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = settled(batch)
        new = batch.select(*rules.READING)
        seen = batch.select("host", "seq", "now_ms", F.col("wall_agent").alias("agent"), F.col("wall_kind").alias("kind"),
                            F.col("wall_percent").alias("used_percent"), "wall_at_ms").dropDuplicates(["host", "seq"])
        old = _stored(spark, path, "readings", batch_id, reading)
        old_walls = _stored(spark, path, "walls", batch_id, wall)
        resets, marks = rules.resumed_resets(new, _stored(spark, path, "marks", batch_id, "host bigint, agent string, kind string, state string"))
        fired = rules.threshold_candidates(old.unionByName(new), thresholds).unionByName(
            rules.wall_candidates(old_walls.unionByName(seen))).join(new.select("host", "seq").distinct(), ["host", "seq"], "left_semi")
        out, limits = rules.resumed_delivery(fired.unionByName(resets), _stored(spark, path, "limits", batch_id, rules.LIMITS))
        out.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        for name, frame in (("readings", rules.speaking(old.unionByName(new), thresholds)),
                            ("walls", rules.speaking_walls(old_walls.unionByName(seen))), ("marks", marks), ("limits", limits)):
            frame.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
            drop_folder(spark, f"{path}/{name}/batch={batch_id - 2}")

    return (observations.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def activity(last_event_ms: int, last_growth_ms: int, mid_turn: bool, now_ms: int) -> str:
    last = max(last_event_ms, last_growth_ms)
    if last == 0 or now_ms - last > DONE_AFTER_MS:
        return "done"
    if now_ms - last <= RUNNING_WITHIN_MS or (mid_turn and now_ms - last_growth_ms <= MID_TURN_MS):
        return "running"
    return "idle"


def session_stream(signals: DataFrame, timeout: bool = False, now_ms: int | None = None, mode: str = "append") -> DataFrame:
    """Activity per (agent, session), an update for each batch that signals it, with the last `seq` it has seen.

    The clock of an update is `now_ms`, or the session's newest signal where none is given.

    With `timeout` a silent session is looked at again by the clock, so it turns
    idle and done without another signal, and its state is then forgotten.

    For a sink in output mode "update" the same rows come from Spark's own aggregates: sessions are many and small, and a
    call of Python for each of them is nearly all the time that a sink in "append" needs.
    """
    if mode == "update":
        if timeout:
            raise ValueError("sessions that time out need output mode append")
        return _aggregated_sessions(signals, now_ms)
    columns = ["agent", "session_id", "last_event_ms", "last_growth_ms", "mid_turn", "state", "seq"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        event, growth, mid, seq = state.get if state.exists else (0, 0, False, 0)
        if state.hasTimedOut:
            now = state.getCurrentProcessingTimeMs()
            verdict = activity(event, growth, mid, now)
            if verdict == "done":
                state.remove()
            else:
                state.setTimeoutDuration(RUNNING_WITHIN_MS)
            yield pd.DataFrame([(*key, event, growth, mid, verdict, seq)], columns=columns)
            return
        # Newest times and the newest signal: batches as they come, in any order, none of them kept.
        for rows in batches:
            grown, at, seqs = (rows["kind"] == "growth").to_numpy(), rows["at_ms"].to_numpy(), rows["seq"].to_numpy()
            timed = at == at  # a null is not equal to itself
            growth = int(at[grown & timed].max(initial=growth))
            event = int(at[~grown & timed].max(initial=event))
            last = np.nanargmax(seqs)
            if int(seqs[last]) >= seq:
                seq, mid = int(seqs[last]), bool(grown[last])
        state.update((event, growth, mid, seq))
        if timeout:
            state.setTimeoutDuration(RUNNING_WITHIN_MS)
        clock = max(event, growth) if now_ms is None else now_ms
        yield pd.DataFrame([(*key, event, growth, mid, activity(event, growth, mid, clock), seq)], columns=columns)

    return signals.groupBy("agent", "session_id").applyInPandasWithState(
        step, "agent string, session_id string, last_event_ms bigint, last_growth_ms bigint, mid_turn boolean, "
        "state string, seq bigint", "event bigint, growth bigint, mid boolean, seq bigint", "append",
        GroupStateTimeout.ProcessingTimeTimeout if timeout else GroupStateTimeout.NoTimeout)


def _aggregated_sessions(signals: DataFrame, now_ms: int | None) -> DataFrame:
    grown = F.coalesce(F.col("kind") == "growth", F.lit(False))
    seq = F.when(F.col("seq") >= 0, F.col("seq"))
    kept = signals.groupBy("agent", "session_id").agg(
        F.greatest(F.max(F.when(~grown, F.col("at_ms"))), F.lit(0)).cast("bigint").alias("last_event_ms"),
        F.greatest(F.max(F.when(grown, F.col("at_ms"))), F.lit(0)).cast("bigint").alias("last_growth_ms"),
        F.coalesce(F.max_by(grown, seq), F.lit(False)).alias("mid_turn"), F.coalesce(F.max(seq), F.lit(0)).cast("bigint").alias("seq"))
    clock = F.greatest("last_event_ms", "last_growth_ms") if now_ms is None else F.lit(now_ms)
    state = activity_of(F.col("last_event_ms"), F.col("last_growth_ms"), F.col("mid_turn"), clock)
    return kept.select("agent", "session_id", "last_event_ms", "last_growth_ms", "mid_turn", state.alias("state"), "seq")


def observe(memory: dict, row, thresholds: tuple[int, ...]) -> list[dict]:
    """One observation of a host: moves every latch and returns the alerts that go out.

    `row` has the reading (agent, kind, used_percent, resets_at_ms) and the nearest
    wall (wall_agent, wall_kind, wall_at_ms, wall_percent), null when none is in sight.
    """
    now, found = int(row.now_ms), []

    def candidate(priority: int, alert: str, agent: str, kind: str, **more) -> None:
        found.append({"priority": priority, "alert": alert, "agent": agent, "kind": kind, **more})

    if pd.isna(row.wall_at_ms):
        memory["wall"] = False
    else:
        away = int(row.wall_at_ms) - now
        if away > rules.WALL_REARM_MS:
            memory["wall"] = False
        if not memory.get("wall") and away <= rules.WALL_FIRE_MS:
            memory["wall"] = True
            candidate(rules.WALL_PRIORITY, "wall_imminent", row.wall_agent, row.wall_kind,
                      percent=float(row.wall_percent), wall_at_ms=int(row.wall_at_ms))

    percent = min(max(float(row.used_percent), 0.0), 100.0)
    window = memory.setdefault("windows", {}).setdefault(f"{row.agent}/{row.kind}", {"latched": [], "high": -1.0})
    window["latched"] = [t for t in window["latched"] if percent > t - rules.REARM_DROP]
    first = window["high"] < 0
    crossed = [t for t in thresholds if percent >= t and t not in window["latched"]]
    window["latched"] += crossed
    if first:
        window["high"] = percent
        crossed = [t for t in crossed if t >= rules.FIRST_FIRE_FLOOR]
    elif window["high"] >= rules.RESET_FLOOR and percent <= window["high"] - rules.RESET_DROP:
        candidate(rules.RESET_PRIORITY, "window_reset", row.agent, row.kind, percent=percent,
                  prev_high=window["high"])
        window["high"] = percent
    else:
        window["high"] = max(window["high"], percent)
    if crossed:
        candidate(rules.THRESHOLD_BASE + max(crossed), "threshold", row.agent, row.kind, percent=percent,
                  threshold=max(crossed), resets_at_ms=int(row.resets_at_ms))

    sent, fired = [], memory.setdefault("fired", {})
    for c in sorted(found, key=lambda c: (-c["priority"], c["agent"], c["kind"])):
        slot = f"{c['agent']}/{c['alert']}"
        if len(sent) == rules.MAX_PER_OBSERVATION or now - fired.get(slot, now - rules.RATE_LIMIT_MS) < rules.RATE_LIMIT_MS:
            continue
        fired[slot] = now
        sent.append({"seq": int(row.seq), "now_ms": now, **c})
    return sent


ALERT_COLUMNS = ["host", "seq", "now_ms", "agent", "kind", "alert", "threshold", "percent", "prev_high"]


def alert_stream(observations: DataFrame, thresholds: tuple[int, ...] = rules.DEFAULT_THRESHOLDS) -> DataFrame:
    """Delivered alerts per host, one observation after the other."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory = json.loads(state.get[0]) if state.exists else {}
        for rows in _ordered(batches, ["host"]):
            out = [{"host": key[0], **alert} for row in rows.itertuples() for alert in observe(memory, row, thresholds)]
            if out:
                yield pd.DataFrame(out, columns=ALERT_COLUMNS).astype({"threshold": "Int32"})
        state.update((json.dumps(memory),))

    return observations.groupBy("host").applyInPandasWithState(
        step, "host bigint, seq bigint, now_ms bigint, agent string, kind string, alert string, threshold int, "
        "percent double, prev_high double", "memory string", "append", GroupStateTimeout.NoTimeout)
