"""Many small files, one for every file name, written by the tasks that hold their rows.

Spark's writers take a folder for each name, and their committer moves those one after another on the driver: some milliseconds a file, which
no executor shortens. Here each task writes the files of its names itself. A file is written beside its target and then moved there, so a
task that runs again only writes the same files once more. ``folder=...`` below the path, by a hash of the name, keeps listings short.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctables.sinks.shipped import ship_package

FOLDERS = 256
#: Compression of files by the extension that tells it.
CODECS = {"": None, ".gz": "gzip", ".bz2": "bz2", ".zst": "zstd"}


class _Tables:
    """Parquet files."""

    def __init__(self, stream, schema: pa.Schema):
        self.stream, self.writer = stream, pq.ParquetWriter(stream, schema, use_dictionary=False, write_statistics=False, store_schema=False)

    def write(self, batch: pa.RecordBatch) -> None:
        self.writer.write_batch(batch)

    def close(self) -> None:
        self.writer.close()
        self.stream.close()


class _Texts:
    """Text files, a line break after every row; missing texts are empty."""

    def __init__(self, stream, schema: pa.Schema):
        self.stream = stream

    def write(self, batch: pa.RecordBatch) -> None:
        for text in batch.column(0):
            self.stream.write((text.as_py() or "").encode() + b"\n")

    def close(self) -> None:
        self.stream.close()


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, str, pa.RecordBatch]]:
    """folder, name and the other columns of neighbouring rows of one name."""
    codes = batch.column("_name").dictionary_encode().indices.to_numpy()
    cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), batch.num_rows]
    content = batch.drop_columns(["_folder", "_name"])
    for a, b in zip(cuts, cuts[1:]):
        yield batch.column("_folder")[a].as_py(), batch.column("_name")[a].as_py(), content.slice(a, b - a)


def _write(rows: DataFrame, path: str, name: str, form: Callable, dealt: bool = False, packed: str = "") -> None:
    """``dealt``: the rows of a name stand together, each in one task, and are not moved. ``packed``: the extension of compressed files."""
    ship_package(rows.sparkSession)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = fs.FileSystem.from_uri(path)
        last, out, n, made = None, None, 0, set()

        def done():
            out.close()
            system.move(beside, target)

        try:
            for batch in batches:
                for folder, file, content in _runs(batch) if batch.num_rows else ():
                    if file != last:
                        if out:
                            done()
                        at = f"{top}/folder={folder}"
                        if folder not in made:
                            system.create_dir(at)
                            made.add(folder)
                        target, beside = f"{at}/{file}{packed}", f"{at}/_{uuid4().hex}"
                        last, out, n = file, form(system.open_output_stream(beside, compression=CODECS[packed]), content.schema), n + 1
                    out.write(content)
            if out:
                done()
                out = None
        finally:
            if out:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    named = rows.filter(F.col(name).isNotNull()).withColumn("_folder", F.pmod(F.xxhash64(name), F.lit(FOLDERS)).cast("int")).withColumnRenamed(name, "_name")
    placed = named if dealt else named.repartition("_folder", "_name").sortWithinPartitions("_folder", "_name")
    placed.mapInArrow(written, "n long").agg(F.sum("n")).first()


def write_table_files(rows: DataFrame, path: str, name: str = "file_name") -> None:
    """A Parquet file of the rows of every file name, without the name. Rows without a name are left out."""
    _write(rows, path, name, _Tables)


def write_text_files(lines: DataFrame, path: str, name: str = "file_name", text: str = "value", dealt: bool = False, packed: str = "") -> None:
    """A text file of the lines of every file name. Rows without a name are left out.

    ``dealt``: the lines of a name already stand together, each name in one task, and are written where they are. ``packed``: ``.gz`` or
    another of ``CODECS``: files are compressed, and this stands behind their names.
    """
    _write(lines.select(name, text), path, name, _Texts, dealt, packed)
