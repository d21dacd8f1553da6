"""Repeated sweeps over logs that grow, ledgers and documents that are rewritten, into the cube (SRC1, SRC10-SRC12, SRC17, D2, C1, C5, C6, U1).

One contract for every source: what its last sweep left goes in, new events (or the newest versions of its
records) and what the next sweep has to know come out.

* A log leaves, per file, its size, its time, the byte after the last complete line, and the few lines that speak for
  later ones (`fleet.SourceSpec.speaks`: session, directory, model, last counters). A sweep lists the files, opens those that
  changed at that byte, puts the speaking lines before the new ones and parses both; events of lines that were
  taken before are not handed on, so readings without a key are never counted twice either. A file that became shorter was cut and
  starts again.
* A ledger leaves a high-water mark per database, and the ids read at the mark itself where a mark can be shared. Its reader starts
  from the mark.
* Rewritten documents hold versions of records. A sweep compares them with the versions that the store holds, and what
  they have grown by goes into the same cube as additive rows.

Keys that were stored are looked up in the buckets that a sweep's own keys fall into (`operators/keystore.py`).

Every sweep has a generation number and writes the next state under it, last of all; a
sweep that broke off is repeated and overwrites what it had written. States older than the last two are removed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.functions.money import COST
from meterline.operators import cdc, cube, dedup, keystore
from meterline.operators.pricing import price_rows
from meterline.operators.projects import with_project
from meterline.operators.scan import union_all
from meterline.session import drop_folder, settled
from meterline.sources import fleet, resume
from meterline.sources.ledgers import MARKS

FILE_STATE = ("agent string, source_file string, modified timestamp, length bigint, taken bigint, "
              "spoken array<struct<value:string,line_start:bigint,line_seq:bigint>>")
RECORD_KEYS = ["agent", "source_file", "key"]
RECORD_FIELDS = ("agent", *cdc.VERSION_FIELDS, "cost_usd")
VERSIONS = ("agent string, source_file string, key string, ts_ms bigint, model string, input_tokens bigint, output_tokens bigint, "
            f"cache_creation_tokens bigint, cache_read_tokens bigint, session_id string, cwd string, cost_usd {COST}")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def files(spark: SparkSession, paths: str | list[str], glob: str) -> DataFrame:
    """source_file, modified, length of the files as a log names them; contents are not read.

    Spark lists 32 small files in a task, and whatever is made of the list would keep those tasks: a row each for a file, they are put together.
    """
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
              .option("pathGlobFilter", glob).load(paths))
    return listed.select(F.col("_metadata.file_path").alias("source_file"),
                         F.col("modificationTime").alias("modified"), "length").coalesce(resume.tasks_of(spark))


@dataclass
class Taken:
    """What one source gives to a sweep, read to its end."""

    events: DataFrame | None = None
    records: DataFrame | None = None
    files: DataFrame | None = None
    marks: DataFrame | None = None
    bytes: int | None = None


def tail(spark: SparkSession, agent: str, paths: str | list[str], known: DataFrame) -> Taken:
    """The events of lines that a log's files have grown by, and the next state of the changed files."""
    spec = fleet.SOURCES[agent]
    here = files(spark, paths, spec.glob)
    before = known.filter(F.col("agent") == agent).select(
        "source_file", F.col("modified").alias("was_modified"), F.col("length").alias("was_length"), "taken", "spoken")
    compared = here.join(before, "source_file", "left")
    changed = compared.filter(~(F.col("modified").eqNullSafe(F.col("was_modified"))
                                & F.col("length").eqNullSafe(F.col("was_length"))))
    grown = F.col("length") >= F.col("was_length")
    changed = settled(changed.select(
        "source_file", "modified", "length", F.when(grown, F.col("taken")).otherwise(0).cast("bigint").alias("first"),
        F.when(grown, F.col("spoken")).alias("spoken")))
    log = settled(resume.read_from(changed))
    spoken = changed.select("source_file", F.explode("spoken").alias("s")).select(
        "s.value", "source_file", "s.line_start", "s.line_seq")
    # Lines that were read before stand before the first byte of this reading.
    both = log.drop("line_end").unionByName(spoken)
    events = spec.parse(both).join(changed.select("source_file", "first"), "source_file").filter(
        F.col("line_seq") >= F.col("first")).drop("first")
    ends = log.groupBy("source_file").agg(F.max("line_end").alias("end"))
    state = changed.drop("spoken").join(ends, "source_file", "left")
    if spec.speaks:
        said = spec.speaks(both).groupBy("source_file").agg(F.collect_list(F.struct("value", "line_start", "line_seq")).alias("spoken"))
        state = state.join(said, "source_file", "left")
    else:
        state = state.withColumn("spoken", F.lit(None).cast("array<struct<value:string,line_start:bigint,line_seq:bigint>>"))
    state = state.select(F.lit(agent).alias("agent"), "source_file", "modified", "length",
                         F.coalesce("end", "first").alias("taken"), "spoken")
    size = log.agg(F.sum(F.col("line_end") - F.col("line_seq"))).first()[0] or 0
    return Taken(events=settled(events), files=settled(state), bytes=size)


def records(spark: SparkSession, agent: str, paths: str | list[str], prices: DataFrame | None) -> DataFrame:
    """The newest version of every record of a source's documents, with its cost."""
    rows = fleet.SOURCES[agent].read(spark, paths)
    cwd = F.col("cwd") if "cwd" in rows.columns else F.lit("")
    # A document lists its records in order; a ledger says when each was updated.
    order = "position" if "position" in rows.columns else "time_updated"
    newest = cdc.last_in_snapshot(rows.withColumn("cwd", cwd), RECORD_KEYS, [order])
    columns = dict.fromkeys([*RECORD_KEYS, *RECORD_FIELDS])
    return settled(price_rows(newest, prices).select(*columns))


def taken(spark: SparkSession, agent: str, where: str | list[str], files: DataFrame, marks: DataFrame,
          prices: DataFrame | None) -> Taken:
    """One source, whatever its kind; raises whatever goes wrong with it."""
    spec = fleet.SOURCES.get(agent)
    if spec is None:
        raise ValueError(f"no source is named {agent}")
    if spec.kind == "versions":
        return Taken(records=records(spark, agent, where, prices))
    if spec.since:
        events, after = spec.since(spark, where, marks.filter(F.col("agent") == agent))
        return Taken(events=settled(events), marks=settled(after))
    return tail(spark, agent, where, files)


def _state(spark: SparkSession, store: str, name: str, generation: int, schema: str) -> DataFrame:
    return _read(spark, f"{store}/{name}/generation={generation}", schema)


def sweep_into_cube(spark: SparkSession, paths: dict[str, str | list[str]], store: str, generation: int,
                    tz_offset_min: int = 0, prices: DataFrame | None = None) -> DataFrame:
    """Take what is new in the sources into the cube below `store`; a status row per source, with the bytes of lines read.

    Each source is read to its end inside its own `try`: one that fails, while planning or while
    running, whatever it raises, is reported, keeps its old state and stops no other.
    """
    known, marks = (_state(spark, store, name, generation - 1, schema) for name, schema in (("files", FILE_STATE), ("marks", MARKS)))
    status, got = [], []
    for agent, where in paths.items():
        try:
            one = taken(spark, agent, where, known, marks, prices)
        except Exception as problem:  # noqa: BLE001 - it is this source's alone
            status.append((agent, False, fleet.problem_of(problem), None))
            continue
        got.append((agent, one))
        status.append((agent, True, "", one.bytes))
    cells = []
    stored = _state(spark, store, "versions", generation - 1, VERSIONS)
    snapshots = [t.records for _, t in got if t.records is not None]
    if snapshots:
        snapshot = union_all(snapshots)
        changed = settled(cdc.changes(stored, snapshot, RECORD_KEYS, RECORD_FIELDS))
        cells.append(cube.build_cells(with_project(cdc.delta_events(changed)), "minute"))
        stored = cdc.merged(stored, snapshot, RECORD_KEYS)
    found = [t.events for _, t in got if t.events is not None]
    if found:
        first = settled(dedup.keep_first(union_all(found)))
        keys = keystore.matching(spark, f"{store}/keys", first, generation)
        fresh = settled(with_project(dedup.not_yet_stored(first, keys)))
        cells.append(cube.build_cells(fresh, "minute", 0, prices))
        keystore.add(fresh, f"{store}/keys", generation)
    if cells:
        minute = settled(union_all(cells))
        tag = f"sweep-{generation:06d}"
        cube.append(minute, store, "minute", tag)
        cube.append(cube.coarsen(minute, "hour"), store, "hour", tag)
        cube.append(cube.coarsen(minute, "day", tz_offset_min), store, "day", tag)
    stored.write.mode("overwrite").parquet(f"{store}/versions/generation={generation}")
    swept = [agent for agent, t in got if t.marks is not None]
    moved = [t.marks for _, t in got if t.marks is not None]
    union_all([marks.filter(~F.col("agent").isin(swept)), *moved]).write.mode("overwrite").parquet(f"{store}/marks/generation={generation}")
    states = [t.files for _, t in got if t.files is not None]
    changed = union_all(states) if states else spark.createDataFrame([], FILE_STATE)
    kept = known.join(changed, ["agent", "source_file"], "left_anti")
    kept.select(changed.columns).unionByName(changed).write.mode("overwrite").parquet(
        f"{store}/files/generation={generation}")
    for name in ("files", "marks", "versions"):
        drop_folder(spark, f"{store}/{name}/generation={generation - 2}")
    return spark.createDataFrame(status, "agent string, ok boolean, problem string, bytes bigint")
