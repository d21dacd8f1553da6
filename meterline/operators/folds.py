"""Sequential state machines over hot keys, run chunk by chunk.

Some operators step a state through the rows of a key and have no window form.
`chunked_fold` cuts a key into consecutive bounded chunks and works in three
steps: summarise every chunk for an unknown incoming state (parallel), pass the
state along the summaries (one small row per chunk, streamed, never held as a
group), and replay every chunk from its now known state (parallel).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.session import settled

CHUNK_ROWS = 65_536


def chunked_fold(df: DataFrame, keys: list[str], order: list[str], chunk: Column,
                 initial: Any, summarise: Callable[[pd.DataFrame], Any],
                 advance: Callable[[Any, Any], Any],
                 replay: Callable[[pd.DataFrame, Any], pd.DataFrame], schema: str) -> DataFrame:
    """Rows emitted by `replay(rows of a chunk in order, state before the chunk)`.

    `chunk` bounds the rows of one (key, chunk): at most CHUNK_ROWS values of a
    unique order column. Summaries and states travel as JSON.
    """
    source = df.withColumn("chunk_no", chunk)
    states = _states(source, keys, order, initial, summarise, advance, None)
    return _replayed(source, states, keys, order, replay, schema)


def resumed_fold(df: DataFrame, keys: list[str], order: list[str], chunk: Column, known: DataFrame,
                 initial: Any, summarise: Callable[[pd.DataFrame], Any], advance: Callable[[Any, Any], Any],
                 replay: Callable[[pd.DataFrame, Any], pd.DataFrame], schema: str) -> tuple[DataFrame, DataFrame]:
    """`chunked_fold` that goes on from stored states (keys, state) of earlier rows; its rows, and the states after them.

    Keys without new rows keep their state.
    """
    source = df.withColumn("chunk_no", chunk)
    states = settled(_states(source, keys, order, initial, summarise, advance, known))
    after = states.groupBy(*keys).agg(F.max_by("after", "chunk_no").alias("state"))
    kept = known.select(*keys, "state").join(after.select(*keys), keys, "left_anti")
    return _replayed(source, states, keys, order, replay, schema), after.unionByName(kept)


def _states(source: DataFrame, keys: list[str], order: list[str], initial: Any, summarise, advance,
            known: DataFrame | None) -> DataFrame:
    """The state before and after every chunk: one small row each, streamed in the order of a key's chunks."""
    part = [*keys, "chunk_no"]
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.select(*part).schema)

    def to_summary(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        out = rows[part].head(1).copy()
        out["summary"] = json.dumps(summarise(rows))
        return out

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, initial
        for batch in batches:
            before, after = [], []
            for key, summary, start in zip(batch[keys].itertuples(index=False, name=None), batch["summary"], batch["start"]):
                if key != current:
                    current, state = key, initial if start is None else json.loads(start)
                before.append(json.dumps(state))
                state = advance(state, json.loads(summary))
                after.append(json.dumps(state))
            yield batch[part].assign(state=before, after=after)

    summaries = source.groupBy(*part).applyInPandas(to_summary, f"{key_schema}, summary string")
    if known is None:
        summaries = summaries.withColumn("start", F.lit(None).cast("string"))
    else:
        summaries = summaries.join(known.select(*keys, F.col("state").alias("start")), keys, "left").select(*part, "summary", "start")
    return (summaries.repartition(*keys).sortWithinPartitions(*part)
            .mapInPandas(carry, f"{key_schema}, state string, after string"))


def _replayed(source: DataFrame, states: DataFrame, keys: list[str], order: list[str], replay, schema: str) -> DataFrame:
    part = [*keys, "chunk_no"]

    def run(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        return replay(rows.sort_values(order, kind="stable"), json.loads(known["state"].iloc[0]))

    return source.groupBy(*part).cogroup(states.groupBy(*part)).applyInPandas(run, schema)
