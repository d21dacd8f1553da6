"""Small helpers of the operators: tables, words, in-row bindings, the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.session import checkpoint_root

#: The white space between words: space and U+0009 to U+000D, in a class of Java's and DuckDB's regular expressions.
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder that the cluster shares."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table below the shared folder: later steps read what was written, whoever computed it."""
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row, however often `body` names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, in order; of a null or blank text none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE_CHARS)) != ""


def unit(*parts: Column | str) -> Column:
    """A number in [0, 1) drawn from the MD5 of `parts`: the same wherever and whenever it is computed."""
    return draw(*parts).cast("double") / F.lit(float(1 << 52))


def draw(*parts: Column | str) -> Column:
    """52 bits of the MD5 of `parts`, as a long. A null part counts as an empty string."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *texts)), 1, 13), 16, 10).cast("long")
