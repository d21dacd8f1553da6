"""Text lines of append-only logs with their order in the file (SRC1, SRC2).

Files stay splittable: a line is ordered by the start of its split and its place
in the split's task, so one huge log is many tasks and never one record.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = ["line_start", "line_seq"]
_BOM_BYTES = 3


def raw_lines(spark: SparkSession, paths: str | list[str], glob: str = "*.jsonl") -> DataFrame:
    """All lines: value, source_file, file_size, line_start, line_seq."""
    text = (spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob).text(paths))
    return text.select(
        "value", F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("line_start"),
        F.monotonically_increasing_id().alias("line_seq"))


def complete_lines(lines: DataFrame) -> DataFrame:
    """Without an unterminated last line, which its writer may still be growing.

    Bytes tell: with a newline after every line the lengths add up to the file
    size, without the last newline they exceed it by one. Only that one line per
    file is removed, by an anti-join on its unique position.
    """
    per_file = lines.groupBy("source_file").agg(
        F.sum(F.octet_length("value") + 1).alias("bytes"), F.max("file_size").alias("file_size"),
        F.max(F.struct(*ORDER)).alias("final"))
    open_end = per_file.filter((F.col("bytes") - F.col("file_size")).isin(1, 1 - _BOM_BYTES)).select(
        "source_file", *[F.col(f"final.{c}").alias(c) for c in ORDER])
    return lines.join(open_end, ["source_file", *ORDER], "left_anti").select(lines.columns)


def read_log(spark: SparkSession, paths: str | list[str], glob: str = "*.jsonl",
             hold_back: bool = True) -> DataFrame:
    """Lines of a log. Files their writers have closed need no `hold_back`, which counts bytes in a pass of its own."""
    text = raw_lines(spark, paths, glob)
    return (complete_lines(text) if hold_back else text).drop("file_size")


def stream_log(spark: SparkSession, path: str, glob: str = "*.jsonl", files_per_batch: int = 1000) -> DataFrame:
    """Lines of files as they land, closed; the checkpoint of the query remembers which were read."""
    text = (spark.readStream.option("lineSep", "\n").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).text(path))
    return text.select("value", F.col("_metadata.file_path").alias("source_file"),
                       F.col("_metadata.file_block_start").alias("line_start"))


def may_matter(lines: DataFrame, markers: list[str]) -> DataFrame:
    """Lines holding any marker: most of a transcript is dropped before JSON is parsed."""
    return lines.filter(reduce(lambda a, b: a | b, [F.col("value").contains(m) for m in markers]))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` plus costly columns that are computed once per row.

    Predicates on a projected column are pushed below it and compute it again; they
    are not pushed below a generator.
    """
    for name, value in columns.items():
        df = df.select("*", F.explode(F.array(value)).alias(name))
    return df


def whole_files(spark: SparkSession, paths: str | list[str], glob: str) -> DataFrame:
    """One row per file, for documents that are rewritten as a whole."""
    text = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
            .text(paths, wholetext=True))
    return text.select("value", F.col("_metadata.file_path").alias("source_file"))


def listing(spark: SparkSession, paths: str | list[str], glob: str = "*") -> DataFrame:
    """path, modificationTime, length of the files; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob).load(paths).select("path", "modificationTime", "length"))


def corpus_size(spark: SparkSession, paths: str | list[str], glob: str = "*.jsonl") -> DataFrame:
    return listing(spark, paths, glob).agg(F.count("*").alias("files"),
                                           F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
