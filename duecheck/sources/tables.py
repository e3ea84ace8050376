"""Intermediate tables in the shared folder."""

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in spark.checkpoint.dir. Only a local session, where
    driver and tasks share one disk, may fall back to a folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="duecheck-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir() or folder


_NOTED: ContextVar[list[str] | None] = ContextVar("noted", default=None)


@contextmanager
def noted() -> Iterator[list[str]]:
    """The folders of all tables that :func:`stage` stores inside, so that :func:`drop_tables` can remove them."""
    folders: list[str] = []
    token = _NOTED.set(folders)
    try:
        yield folders
    finally:
        _NOTED.reset(token)


def drop_tables(spark: SparkSession, folders: list[str]) -> None:
    """Remove stored tables; nothing may read them any more."""
    for folder in folders:
        fs, made, _ = file_system(spark, folder)
        fs.delete(made(folder), True)


def stage(df: DataFrame, name: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return the stored table.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.
    ``options`` go to the Parquet writer.
    """
    spark = df.sparkSession
    run = f"{name}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"
    path = f"{scratch_dir(spark)}/tables/{run}"
    df.write.options(**(options or {})).parquet(path)
    if _NOTED.get() is not None:
        _NOTED.get().append(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """(file system of ``path``, a maker of its paths, the JVM)."""
    jvm = spark._jvm
    made = jvm.org.apache.hadoop.fs.Path
    return made(path).getFileSystem(spark._jsc.hadoopConfiguration()), made, jvm


def unstage(df: DataFrame) -> None:
    """Remove the stored table that ``df`` only reads from; nothing may read it any more."""
    drop_tables(df.sparkSession, sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a table that sits in few files to all tasks before costly row work.

    A table with as many partitions as there are cores is left as it is.
    """
    width = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(width, *keys) if df.rdd.getNumPartitions() < width else df
