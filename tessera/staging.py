"""Tables that a plan writes once and reads several times."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def staging_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where both are unset, a local session gets a folder of its own; on a cluster that raises, because
    what an executor writes to its own disk nobody else can read.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))
        base = spark.sparkContext.getCheckpointDir()
    return base


def staging_path(spark: SparkSession) -> str:
    """A place in the shared folder that nothing has used."""
    return f"{staging_dir(spark)}/staged/{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are staged inside are deleted at the end, also after a failure: nothing lazy over them may leave."""
    token = _SCRATCH.set([])
    try:
        yield
    finally:
        made = _SCRATCH.get()
        _SCRATCH.reset(token)
        for path in made:
            delete(spark, path)


def staged(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: later reads prune its columns and survive lost executors."""
    path = staging_path(df.sparkSession)
    if (made := _SCRATCH.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SCOPE: ContextVar[dict | None] = ContextVar("scope", default=None)
Build = Callable[[SparkSession, str], DataFrame]


def in_scope(f: Build) -> Build:
    """f, with a scope of its own: what shared builders make while it runs is made once."""

    @functools.wraps(f)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        token = _SCOPE.set({})
        try:
            return f(spark, folder)
        finally:
            _SCOPE.reset(token)

    return run


def shared(f: Build) -> Build:
    """A builder whose table is staged the first time a scope asks for it, and read by all who ask again."""

    @functools.wraps(f)
    def build(spark: SparkSession, folder: str) -> DataFrame:
        scope = _SCOPE.get()
        if scope is None:
            return f(spark, folder)
        if (f.__module__, f.__name__) not in scope:
            scope[f.__module__, f.__name__] = staged(f(spark, folder))
        return scope[f.__module__, f.__name__]

    return build
