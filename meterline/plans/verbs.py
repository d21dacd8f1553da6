"""The query verbs over the stored tiers: history, top, sessions, burn, export, health (SNK2-SNK4, T1, T3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.functions import timecols
from meterline.functions.money import total_tokens
from meterline.functions.timecols import BucketRange
from meterline.operators import cube, ranking, rollups
from meterline.operators.rates import burn_at

EXPORT_DIMENSIONS = ["bucket", "agent", "model", "project", "session_id"]


def history(cells: DataFrame, group_by: list[str], span: BucketRange | None = None, agents: list[str] | None = None,
            model: str | None = None, project: str | None = None, session: str | None = None
            ) -> tuple[DataFrame, str | None]:
    """Usage over time, grouped; an unknown name gives no rows and a note."""
    for kind, name in (("model", model), ("project", project), ("session", session)):
        note = cube.unknown_name_note(cells, kind, name) if name else None
        if note:
            return cube.query(cells.limit(0), group_by or ["bucket"]), note
    bounds = {"from_bucket": span.from_bucket, "to_bucket": span.to_bucket} if span else {}
    return cube.query(cells, group_by, agents=agents, model=model, project=project, session=session, **bounds), None


def top(cells: DataFrame, dimension: str, n: int = 20, from_bucket: int = 0,
        to_bucket: int = timecols.MAX_BUCKET) -> DataFrame:
    return ranking.top_by(cells, dimension, n, from_bucket, to_bucket)


def sessions(cells: DataFrame, tier: str = "day", tz_offset_min: int = 0, n: int = 20,
             span: BucketRange | None = None, agents: list[str] | None = None,
             project: str | None = None) -> DataFrame:
    bounds = {"from_bucket": span.from_bucket, "to_bucket": span.to_bucket} if span else {}
    hits = cube.cube_filter(cells, agents=agents, project=project, **bounds)
    return ranking.newest_sessions(rollups.session_spans(hits, tier, tz_offset_min), n)


def burn(minute_cells: DataFrame, at_ms: int, window_min: int = 15) -> DataFrame:
    return burn_at(minute_cells, at_ms, window_min)


def _money(column: str):
    return F.format_string("%s", F.round(F.col(column), 6).cast("decimal(38,6)").cast("string"))


def export(cells: DataFrame, tier: str = "hour", tz_offset_min: int = 0,
           span: BucketRange | None = None) -> DataFrame:
    """The archival rows: one fixed set of columns, money with six decimals."""
    bounds = {"from_bucket": span.from_bucket, "to_bucket": span.to_bucket} if span else {}
    rows = cube.query(cells, EXPORT_DIMENSIONS, **bounds)
    return rows.select(
        timecols.bucket_start_ms(tier, F.col("bucket"), tz_offset_min).alias("bucket_ms"),
        "agent", "model", "project", F.col("session_id").alias("session"),
        F.col("input_tokens").alias("input"), F.col("output_tokens").alias("output"),
        F.col("cache_creation_tokens").alias("cache_creation"), F.col("cache_read_tokens").alias("cache_read"),
        _money("cost_usd").alias("cost_usd"), "events", _money("covered_cost_usd").alias("covered"),
        F.when(F.col("agent") == "synthetic", "1").otherwise("0").alias("synthetic"))


def write_csv(rows: DataFrame, path: str) -> None:
    """RFC 4180: quotes are doubled, a header in every part file."""
    rows.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def tsv_line(rows: DataFrame) -> DataFrame:
    """One tab-separated line per row; backslash, tab, newline and return are escaped C-style."""
    def escaped(name: str):
        text = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
        for plain, code in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            text = F.replace(text, F.lit(plain), F.lit(code))
        return text

    return rows.select(F.concat_ws("\t", *[escaped(c) for c in rows.columns]).alias("value"))


def write_tsv(rows: DataFrame, path: str) -> None:
    tsv_line(rows).write.mode("overwrite").text(path)


def json_rows(rows: DataFrame, verb: str, span: BucketRange) -> DataFrame:
    """A header row with the resolved query, then one JSON object per result row."""
    spark = rows.sparkSession
    header = spark.range(1).select(F.to_json(F.struct(
        F.lit(verb).alias("verb"), F.struct(
            F.lit(span.tier).alias("bucket"), F.lit(span.basis).alias("time_basis"),
            F.lit(span.tz_offset_min).alias("tz_offset_min"), F.lit(span.since_ms).cast("bigint").alias("since_ms"),
            F.lit(span.until_ms).alias("until_ms"), F.lit(span.from_bucket).alias("from_bucket"),
            F.lit(span.to_bucket).alias("to_bucket")).alias("query")),
        {"ignoreNullFields": "false"}).alias("value"))
    shaped = rows.withColumn("tokens", total_tokens()).withColumns({
        c: F.round(c, 6).cast("double") for c in ("cost_usd", "covered_cost_usd") if c in rows.columns})
    return header.unionAll(shaped.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")))


def write_json(rows: DataFrame, verb: str, span: BucketRange, path: str) -> None:
    json_rows(rows, verb, span).write.mode("overwrite").text(path)
