"""This library in the session's Python workers."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from doctables.sinks.stored import shared_folder

_SENT: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this library to the session's Python workers, whose path may not hold it: once, as an archive in the shared folder."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    top, archive = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, str(file.relative_to(top.parent)))
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}.zip")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = system.create(target)
    stream.write(bytearray(archive.getvalue()))
    stream.close()
    context.addPyFile(system.makeQualified(target).toString())
    _SENT.add(context.applicationId)
