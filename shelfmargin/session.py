"""Session settings, result caching and lineage cuts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


ROWS_PER_TASK = 250_000


def build_session(app: str = "shelfmargin", master: str | None = None, **settings: str) -> SparkSession:
    """A session with adaptive execution and UTC dates; keyword keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def cached(df: DataFrame) -> DataFrame:
    """Keep a result that several outputs read; lost blocks are rebuilt from lineage.

    The caller owns the result and calls ``unpersist()``, or uses ``kept``.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK_DESER)


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` cached for the length of a ``with`` block; act on the results inside it."""
    held = cached(df)
    try:
        yield held
    finally:
        held.unpersist()


def task_count(rows: int, rows_per_task: int = ROWS_PER_TASK) -> int:
    """The number of tasks that leaves each ``rows_per_task`` rows.

    For ``repartition`` by keys before a step that holds its rows in memory: adaptive execution sizes
    tasks by compressed bytes, and of narrow rows 64 MB are millions.
    """
    return max(1, -(-rows // rows_per_task))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors reach.

    ``spark.checkpoint.dir`` names it. Where that is unset and all tasks run in this process, as
    in tests, it is a folder of the warehouse; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder of ``new_folder`` and all it holds; nothing may read it afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the action that made them ends, not when the driver next collects its garbage.

    For steps that each leave a table or checkpoint; a DataFrame that two actions inside read again from
    its shuffles would be computed twice.
    """
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so a retry reads the same rows.

    The files go when the result is no longer referenced (``cleanCheckpoints``).
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
