"""Session settings the jobs rely on, and the shared scratch folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "meterline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job assumes; `conf` wins over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        # Written intermediates go when the frames that read them are gone.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> SparkSession:
    """Casts between NTZ and instants follow the session zone; all instants here are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The folder the cluster shares for checkpoints and written intermediates.

    A machine-local folder is only taken where the cluster names none *and* the
    session is a local one.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not current.isDefined():
            context.setCheckpointDir(named)
        return named
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="meterline-ckpt-"))
    return context._jsc.sc().getCheckpointDir().get()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name for intermediates, below one of this application that is removed when it ends."""
    root = f"{checkpoint_root(spark).rstrip('/')}/{spark.sparkContext.applicationId}"
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        system.mkdirs(where)
        system.deleteOnExit(where)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """`df` written once to the shared checkpoint folder.

    For narrow intermediates that several branches of a plan read: without it each
    branch would compute them again. A lost executor reads the files, it does not
    repeat the work.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def folder_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def drop_matching(spark: SparkSession, pattern: str) -> int:
    """Remove the folders that a glob pattern names; how many there were."""
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.globStatus(where) or []
    for status in found:
        system.delete(status.getPath(), True)
    return len(found)


def drop_folder(spark: SparkSession, path: str) -> bool:
    """Remove a written folder from whatever store it lies in; False where there was none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
