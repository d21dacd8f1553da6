"""SQLite ledgers (SRC10-SRC12, J4).

A Python data source reads each database read-only, in row-id ranges, so a large
ledger is many tasks. Databases must lie where every executor can open them.
"""

from __future__ import annotations

import glob
import json
import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from meterline.schemas import TOKEN_COLUMNS
from meterline.session import settled
from meterline.sources.lines import once
from meterline.sources.transcripts import count_of, text_of

ROWS_PER_TASK = 1_000_000


class _Range(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True, timeout=5)


def _has_table(db: sqlite3.Connection, table: str) -> bool:
    return db.execute("SELECT 1 FROM sqlite_master WHERE type='table' AND name=?", (table,)).fetchone() is not None


class SqliteSource(DataSource):
    """Options: path (file or glob), table, columns (comma list of SQL expressions), rows_per_task.

    `since` is JSON of database -> mark: only rows whose `since_column` is at the mark or above are read. On `rowid` the
    mark moves the first range too, so older rows are not touched.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_ledger"

    def schema(self) -> str:
        raise NotImplementedError("name the columns with .schema(...)")

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options)


class _SqliteReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.table = options["path"], options["table"]
        self.columns = options["columns"]
        self.step = int(options.get("rows_per_task", ROWS_PER_TASK))
        self.since, self.by = json.loads(options.get("since", "{}")), options.get("since_column", "rowid")

    def partitions(self) -> list[_Range]:
        ranges = []
        for path in sorted(glob.glob(self.path)):
            db = _connect(path)
            try:
                if not _has_table(db, self.table):
                    continue
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
            finally:
                db.close()
            if low is not None and self.by == "rowid":
                low = max(low, self.since.get(os.path.abspath(path), low))
            if low is not None:
                ranges += [_Range(path, at, min(at + self.step - 1, high))
                           for at in range(low, high + 1, self.step)]
        return ranges or [_Range("", 0, -1)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        if not partition.path:
            return
        db = _connect(partition.path)
        try:
            mark = self.since.get(os.path.abspath(partition.path))
            above = f" AND {self.by} >= ?" if mark is not None else ""
            rows = db.execute(f"SELECT rowid, {self.columns} FROM {self.table} WHERE rowid BETWEEN ? AND ?{above}",
                              (partition.low, partition.high, *([mark] if mark is not None else [])))
            for row in rows:
                yield (os.path.abspath(partition.path), *row)
        finally:
            db.close()


def read_table(spark: SparkSession, path: str, table: str, columns: dict[str, str],
               rows_per_task: int = ROWS_PER_TASK, since: dict[str, int] | None = None,
               since_column: str = "rowid") -> DataFrame:
    """`columns`: name -> 'SQL expression : Spark type'. Adds db_file and row_id. `since`: the first mark to read, per database."""
    spark.dataSource.register(SqliteSource)
    expressions, fields = [], ["db_file string", "row_id bigint"]
    for name, spec in columns.items():
        expression, kind = (s.strip() for s in spec.rsplit(":", 1))
        expressions.append(f"{expression} AS {name}")
        fields.append(f"{name} {kind}")
    return (spark.read.format("sqlite_ledger").schema(", ".join(fields)).option("path", path)
            .option("table", table).option("columns", ", ".join(expressions))
            .option("rows_per_task", str(rows_per_task)).option("since", json.dumps(since or {}))
            .option("since_column", since_column).load())


def _integer(column: str) -> str:
    return f"CASE WHEN typeof({column})='integer' THEN {column} ELSE CAST(coalesce({column},0) AS INTEGER) END : bigint"


def goose_rows(spark: SparkSession, path: str, since: dict[str, int] | None = None) -> DataFrame:
    return read_table(spark, path, "usage_ledger", {
        "session_id": "session_id : string", "created_timestamp": _integer("created_timestamp"),
        "model": "model : string",
        **{c: _integer(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")}}, since=since)


def goose(rows: DataFrame, above_row: int = 0) -> DataFrame:
    """Ledger rows above a row-id mark; the provider's own cost is never read."""
    kept = rows.filter((F.col("row_id") > above_row) & F.col("session_id").isNotNull()
                       & F.col("model").isNotNull())
    return _nonzero(kept.select(
        F.lit("goose").alias("agent"), (F.col("created_timestamp") * 1000).alias("ts_ms"), "model",
        count_of(F.col("input_tokens")).alias("input_tokens"),
        count_of(F.col("output_tokens")).alias("output_tokens"),
        count_of(F.col("cache_write_tokens")).alias("cache_creation_tokens"),
        count_of(F.col("cache_read_tokens")).alias("cache_read_tokens"), "session_id",
        F.lit("").alias("cwd"), F.col("db_file").alias("source_file"), "row_id"))


def _nonzero(events: DataFrame) -> DataFrame:
    return events.filter(sum((F.col(c) for c in TOKEN_COLUMNS), F.lit(0)) > 0)


_MESSAGE = {"id": "id : string", "session_id": "session_id : string",
            "time_created": "time_created : bigint", "time_updated": "time_updated : bigint",
            "data": "data : string"}


def kilo_rows(spark: SparkSession, path: str, since: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    return (read_table(spark, path, "message", _MESSAGE, since=since, since_column="time_updated"),
            read_table(spark, path, "session", {"id": "id : string", "model": "model : string"}))


def kilo(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Assistant messages with tokens; the model comes from the message, else from its session."""
    parsed = once(messages, j=F.from_json("data", (
        "role string, modelID string, model struct<id string>, tokens struct<input bigint, "
        "output bigint, reasoning bigint, cache struct<read bigint, write bigint>>"))).filter(
        (F.col("j.role") == "assistant") & F.col("j.tokens").isNotNull())
    owner = sessions.select("db_file", F.col("id").alias("session_id"), F.from_json(
        "model", "id string")["id"].alias("session_model"))
    joined = parsed.join(owner, ["db_file", "session_id"], "left")

    def present(value: Column) -> Column:
        return F.when(value != "", value)

    model = F.coalesce(present(F.col("j.model.id")), present(F.col("j.modelID")),
                       present(F.col("session_model")))
    return _nonzero(joined.select(
        F.lit("kilo").alias("agent"), F.col("time_created").alias("ts_ms"), model.alias("model"),
        count_of(F.col("j.tokens.input")).alias("input_tokens"),
        (count_of(F.col("j.tokens.output")) + count_of(F.col("j.tokens.reasoning"))).alias("output_tokens"),
        count_of(F.col("j.tokens.cache.write")).alias("cache_creation_tokens"),
        count_of(F.col("j.tokens.cache.read")).alias("cache_read_tokens"),
        text_of(F.col("session_id")).alias("session_id"), F.lit("").alias("cwd"),
        F.col("db_file").alias("source_file"), "id", "time_updated").filter(F.col("model").isNotNull()))


#: What a sweep remembers of a ledger: per database its high-water mark, and the ids read at the mark itself.
MARKS = "agent string, db_file string, mark bigint, id string"


def _marks(known: DataFrame) -> dict[str, int]:
    """A mark per database, and the reader plans one task or more per database anyway."""
    return {r["db_file"]: r["mark"] for r in known.groupBy("db_file").agg(F.max("mark").alias("mark")).collect()}


def _kept(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """The marks after a sweep: a database without new rows keeps its own."""
    return fresh.unionByName(known.join(fresh.select("db_file").distinct(), "db_file", "left_anti").select(fresh.columns))


def goose_since(spark: SparkSession, path: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events of rows above the row-id marks, next marks)."""
    rows = settled(goose_rows(spark, path, {db: mark + 1 for db, mark in _marks(known).items()}))
    fresh = rows.groupBy("db_file").agg(F.max("row_id").alias("mark")).select(
        F.lit("goose").alias("agent"), "db_file", "mark", F.lit(None).cast("string").alias("id"))
    events = goose(rows).withColumns({"line_start": F.col("row_id"), "line_seq": F.lit(0).cast("bigint"),
                                      "dedup_key": F.lit(None).cast("string")}).drop("row_id")
    return events, _kept(known, fresh)


def kilo_since(spark: SparkSession, path: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events of messages at or above the update marks that were not read at the mark before, next marks and their ids)."""
    messages, sessions = kilo_rows(spark, path, _marks(known))
    messages = settled(messages)
    seen = known.select("db_file", F.col("mark").alias("time_updated"), "id")
    unread = messages.join(seen, ["db_file", "time_updated", "id"], "left_anti").select(messages.columns)
    newest = messages.groupBy("db_file").agg(F.max("time_updated").alias("mark")).where("mark IS NOT NULL")
    fresh = messages.join(newest, "db_file").where(F.col("time_updated") == F.col("mark")).select(
        F.lit("kilo").alias("agent"), "db_file", "mark", "id").distinct()
    key = F.concat_ws(":", "source_file", "id", F.col("time_updated").cast("string"))
    events = kilo(unread, sessions).withColumns({
        "dedup_key": key, "line_start": F.col("time_updated"), "line_seq": F.lit(0).cast("bigint")}).drop("id", "time_updated")
    return events, _kept(known, fresh)


def opencode_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages of the first schema, of the next schema, and sessions."""
    return (read_table(spark, path, "message", _MESSAGE),
            read_table(spark, path, "session_message", {**_MESSAGE, "type": "type : string"}),
            read_table(spark, path, "session", {"id": "id : string", "directory": "directory : string"}))


def opencode(messages: DataFrame, next_messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Current versions of assistant messages, keyed by id, ready for change capture.

    A database with an assistant row in the next schema is read from that schema
    alone. Counters that are not whole and non-negative drop the row.
    """
    schema = ("role string, modelID string, model struct<id string>, "
              "time struct<created bigint, completed bigint>, tokens struct<input string, "
              "output string, reasoning string, cache struct<read string, write string>>")
    modern = once(next_messages.filter(F.col("type") == "assistant"), j=F.from_json("data", schema))
    modern_files = modern.select("db_file").distinct()
    first = once(messages, j=F.from_json("data", schema)).filter(F.col("j.role") == "assistant")
    legacy = first.join(modern_files, "db_file", "left_anti").withColumn("model", F.col("j.modelID"))
    chosen = modern.withColumn("model", F.coalesce("j.model.id", "j.modelID")).drop("type").unionByName(
        legacy.select(*[c for c in modern.columns if c != "type"], "model"))

    def whole(path: str) -> Column:
        text = F.coalesce(F.col(f"j.tokens.{path}"), F.lit("0"))
        return F.when(text.rlike(r"^\d+$"), text.cast("bigint"))

    counters = {"i": whole("input"), "o": whole("output"), "r": whole("reasoning"),
                "cr": whole("cache.read"), "cw": whole("cache.write")}
    owner = sessions.select("db_file", F.col("id").alias("session_id"), "directory")
    rows = chosen.join(owner, ["db_file", "session_id"]).withColumns(counters)
    return rows.filter(F.col("model").isNotNull()).dropna(subset=list(counters)).select(
        F.col("db_file").alias("source_file"), F.col("id").alias("key"), "time_updated",
        F.lit("opencode").alias("agent"),
        F.coalesce("j.time.completed", "j.time.created", "time_created").alias("ts_ms"), "model",
        F.col("i").alias("input_tokens"), (F.col("o") + F.col("r")).alias("output_tokens"),
        F.col("cw").alias("cache_creation_tokens"), F.col("cr").alias("cache_read_tokens"),
        text_of(F.col("session_id")).alias("session_id"), text_of(F.col("directory")).alias("cwd"))
