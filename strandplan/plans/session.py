"""Shared-folder helpers: where loops cut lineage and stages are written."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what ``spark.checkpoint.dir`` names. Only where that is unset and all of Spark is one process (tests)
    a temporary folder is made and registered; elsewhere executors would each write to a disk of their own, so
    that raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strandplan-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; an open ``scratch`` block removes it at its end."""
    path = f"{shared_root(spark)}/strandplan/{label}-{uuid.uuid4().hex}"
    mine = _session(spark)
    for session, paths in reversed(_scopes.get()):
        if session == mine:
            paths.append(path)
            break
    return path


#: (session, paths handed out) of each open ``scratch`` block of this thread of control, innermost last.
_scopes: ContextVar[tuple[tuple[str, list[str]], ...]] = ContextVar("scopes", default=())


def _session(spark: SparkSession) -> str:
    return spark._jsparkSession.sessionUUID()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, all tables that this thread wrote for this session inside the block.

    A frame made inside reads those tables, so what is wanted of it is written or collected before the end; a
    path taken outside the block, by another thread or for another session stays.
    """
    paths: list[str] = []
    before = _scopes.set((*_scopes.get(), (_session(spark), paths)))
    try:
        yield
    finally:
        _scopes.reset(before)
        for path in paths:
            remove(spark, path)


def written_at(df: DataFrame, label: str, path: str | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet below the shared folder (or at ``path``); the table read back, and its path.

    The lineage ends there, so a lost executor costs a re-read, and Catalyst knows the exact size, so it
    broadcasts the table only below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = path or shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, label: str) -> DataFrame:
    """``written_at`` without the path."""
    return written_at(df, label)[0]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table stands at a path, finished."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


BATCH_ROWS, BATCH_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_MB = 2


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes that one Arrow batch to Python holds, as texts may be long.

    The session's setting is only ever lowered, and to one value, so no frame changes how another runs.
    """
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_BYTES))
    if not 0 < now <= BATCH_MB << 20:
        spark.conf.set(BATCH_BYTES, f"{BATCH_MB}m")


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most ``rows`` rows an Arrow batch for the actions inside the block; what was set before comes back."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


#: Spark's own switch: shuffle files of an action go when it ends, not when the driver next collects garbage.
SHUFFLE_FILES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each action inside the block are removed at the action's end; what was set before comes back.

    For steps that write what they need again. Otherwise files stay until the driver happens to collect garbage,
    so that many actions together may hold several times their input.
    """
    before = spark.conf.get(SHUFFLE_FILES, None)
    spark.conf.set(SHUFFLE_FILES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_FILES)
        else:
            spark.conf.set(SHUFFLE_FILES, before)
