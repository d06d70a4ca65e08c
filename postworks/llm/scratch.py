"""Tables that cut lineage, in the folder that all machines of the cluster share."""

from __future__ import annotations

import contextlib
import contextvars
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_passing: contextvars.ContextVar[list | None] = contextvars.ContextVar("passing", default=None)


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="postworks-")


def _folder(spark: SparkSession) -> str:
    """The application's folder below spark.checkpoint.dir, or else below the context's checkpoint directory.

    Where neither is set there is a local folder, as in tests, but only if no
    executor can be on another machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else None
    if not base:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        base = _own_folder()
    return f"{base.rstrip('/')}/postworks/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's shared folder."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has written; results that still read them must have been saved."""
    _delete(spark, _folder(spark))


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """From now on rows reach Python in Arrow batches of at most so many bytes, however long the texts are.

    The setting stays, as results are computed only later; one that is smaller already is left alone.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    known = spark.conf.get(name, None)
    if not (known and known.isdigit() and 0 < int(known) <= most):
        spark.conf.set(name, str(most))


_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Queries that run within the block delete their shuffle files when they end, not when the driver happens to collect its garbage."""
    known = spark.conf.get(_SHUFFLES_GO, None)
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(_SHUFFLES_GO) if known is None else spark.conf.set(_SHUFFLES_GO, known)


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """The rows of df, written as Parquet and read again: lost executors lose no part of it. What was shuffled for it goes at once."""
    path = shared_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    with _shuffles_go(df.sparkSession):
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    if (passing := _passing.get()) is not None:
        passing.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def passing_tables(spark: SparkSession) -> Iterator[list]:
    """Tables written within the block are deleted at its end, but for those that `keep` was called for."""
    outer, own = _passing.get(), []
    token = _passing.set(own)
    try:
        yield own
    finally:
        _passing.reset(token)
        for path in own:
            if outer is not None and getattr(path, "kept", False):
                outer.append(str(path))
            elif not getattr(path, "kept", False):
                _delete(spark, path)


class _Kept(str):
    kept = True


def keep(table: DataFrame) -> DataFrame:
    """The table, which was written last within the block, outlives it."""
    own = _passing.get()
    if own:
        own[-1] = _Kept(own[-1])
    return table
