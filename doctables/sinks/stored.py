"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``. Only a session on one machine may go without that setting: it takes the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return os.path.join(base, f"doctables-{uuid4().hex}")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What queries shuffle in here is deleted when they end, not when the driver happens to collect garbage: nothing reads it again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(table: DataFrame, by: list[str] = [], tasks: int = 0) -> DataFrame:
    """Write a table to a new shared folder and read it from there.

    For a derived table that the next steps read more than once: each reading takes only its columns from the files, nothing is
    derived twice, and a lost executor costs no more than its own tasks. The files stay; they belong to the folder's owner.

    ``by``: columns by which the table comes dealt out to so many ``tasks``. Spark keeps that in mind, and later steps by them (and more
    columns) move no rows.
    """
    spark, path = table.sparkSession, shared_folder(table.sparkSession)
    with shuffles_dropped(spark):
        writer = table.write.option("compression", "zstd")
        if not by:
            writer.parquet(path)
            return spark.read.schema(table.schema).parquet(path)
        title = f"dealt_{uuid4().hex}"
        writer.format("parquet").option("path", path).bucketBy(tasks, *by).saveAsTable(title)
        return spark.table(title)


def release(table: DataFrame) -> None:
    """Delete the files that a stored table was read from, when nothing reads it any more."""
    spark = table.sparkSession
    for file in table.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        if not path.getParent().getName().startswith("doctables-"):
            raise ValueError(f"{file} was not stored by this library")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path.getParent(), True)
