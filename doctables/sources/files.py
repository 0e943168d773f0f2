"""Input files and layout regions.

Spark's readers keep every file's entry on the driver, for listing and for planning. Folders of very many small files are therefore listed and
read by tasks, where Arrow's file systems reach them; for other stores Spark's readers do the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fnmatch import fnmatchcase
from re import sub
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from doctables.functions.fixed_values import PDF_GLOB, PDF_SUFFIX
from doctables.sinks.shipped import ship_package

#: One row per page; a document without pages is one row without page number.
PAGE_FILE = "doc_id bigint, page_no int, ocr_text string"
#: How partition folders are named for missing values.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
# Bytes and rows of a batch of what several small files hold, about.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 8192


def scan_pdf_files(spark: SparkSession, directory: str) -> DataFrame:
    """PDF files of one directory (not below it), any case of the ending; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", PDF_GLOB).option("recursiveFileLookup", False).load(directory)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length")


def _encoded(path: str) -> str:
    """A path as it stands in a URI, and so in Spark's metadata columns."""
    return sub(r"[^\w\x80-\U0010ffff\-.!~'()*,;:$&+=/@]", lambda c: f"%{ord(c[0]):02X}", path)


class Folder(NamedTuple):
    """A folder that tasks list themselves: how Arrow names it, its path there, and what Spark puts before that path."""

    uri: str
    top: str
    prefix: str

    def system(self) -> fs.FileSystem:
        return fs.FileSystem.from_uri(self.uri)[0]


def _reached(spark: SparkSession, path: str, files: str) -> Folder | None:
    """The folder, if Arrow knows its store, it is there, and no pattern needs Hadoop."""
    if set(path) & set("*?[{") or set(files) & set("[{\\"):
        return None
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    uri = quote(f"file://{whole[5:]}" if whole.startswith("file:/") and not whole.startswith("file://") else whole, ":/=+,;@!$&'()~")
    try:
        system, top = fs.FileSystem.from_uri(uri)
        there = whole.endswith(top) and system.get_file_info(top).type == fs.FileType.Directory
    except (OSError, pa.ArrowException):
        return None
    return Folder(uri, top, whole.removesuffix(top)) if there else None


def _hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def _walk(system: fs.FileSystem, folder: str, files: str) -> Iterator[fs.FileInfo]:
    """Files with content below a folder; as in Spark's listings only folders named ``key=value`` are entered, hidden ones are not."""
    for info in system.get_file_info(fs.FileSelector(folder)):
        if info.type == fs.FileType.Directory:
            if "=" in info.base_name and not _hidden(info.base_name):
                yield from _walk(system, info.path, files)
        elif info.size and not _hidden(info.base_name) and fnmatchcase(info.base_name, files):
            yield info


def _listed(spark: SparkSession, folder: Folder, files: str, key: str) -> DataFrame:
    """path, name, named, length of all files below a folder. ``named``: the name is that of a folder ``key=...``, not the file's own."""
    ship_package(spark)
    start = f"{key}="

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = folder.system().get_file_info(fs.FileSelector(folder.top)) if sum(batch.num_rows for batch in batches) else []
        for at in range(0, len(found), BATCH_ROWS):
            columns = zip(*((i.base_name, i.type == fs.FileType.Directory, i.size) for i in found[at : at + BATCH_ROWS]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int64()))], names=["entry", "folder", "size"])

    def row(path: str, size: int) -> tuple[str, str | None, bool, int]:
        below = path[len(folder.top) :].strip("/").split("/")
        values = [unquote(part[len(start) :]) for part in below[:-1] if part.startswith(start)]
        name = (None if values[0] == NO_VALUE else values[0]) if values else _encoded(below[-1])
        return folder.prefix + _encoded(path), name, bool(values), size

    def told(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["path", "name", "named", "length"])

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, rows = folder.system(), []
        for entry in (e for batch in batches for e in batch.to_pylist()):
            name, path = entry["entry"], f"{folder.top}/{entry['entry']}"
            if entry["folder"]:
                found = ((i.path, i.size) for i in (_walk(system, path, files) if "=" in name and not _hidden(name) else ()))
            else:
                found = [(path, entry["size"])] if entry["size"] and not _hidden(name) and fnmatchcase(name, files) else []
            for path, size in found:
                rows.append(row(path, size))
                if len(rows) >= BATCH_ROWS:
                    yield told(rows)
                    rows = []
        if rows:
            yield told(rows)

    entries = spark.range(0, 1, 1, 1).mapInArrow(opened, "entry string, folder boolean, size bigint").repartition(_tasks(spark), "entry")
    return entries.mapInArrow(entered, "path string, name string, named boolean, length bigint")


def _tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def _read(listing: DataFrame, folder: Folder, schema: StructType, batches_of: Callable) -> DataFrame:
    """The rows of ``schema`` that ``batches_of(system, path)`` gives for each listed file, after its ``path``, ``name`` and ``named``.

    Files are dealt out by their paths; small ones share a batch.
    """
    plain = to_arrow_schema(schema)
    own = ["path", "name", "named"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, held, rows, size = folder.system(), [], 0, 0
        for file in (f for batch in batches for f in batch.to_pylist()):
            for got in batches_of(system, unquote(file["path"][len(folder.prefix) :])):
                n = got.num_rows
                told = [pa.array([file[c]] * n, t) for c, t in zip(own, (pa.string(), pa.string(), pa.bool_()))]
                held.append(pa.RecordBatch.from_arrays([*told, *got.columns], names=[*own, *plain.names]))
                rows, size = rows + n, size + got.nbytes
                if rows >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, rows, size = [], 0, 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    kinds = StructType([*StructType.fromDDL("path string, name string, named boolean").fields, *schema.fields])
    return listing.select(*own).repartition(_tasks(listing.sparkSession), "path").mapInArrow(read, kinds)


def list_files(spark: SparkSession, path: str, files: str = "*") -> DataFrame:
    """Files below a folder: path, file_name, length; contents are not read.

    ``file_name`` is the name of the file, or that of its folder if folders are named ``file_name=...``, as Spark's writers lay them out.
    """
    if folder := _reached(spark, path, files):
        return _listed(spark, folder, files, "file_name").select("path", F.col("name").alias("file_name"), "length")
    found = spark.read.format("binaryFile").option("pathGlobFilter", files).load(path)
    name = F.col("file_name") if "file_name" in found.columns else F.col("_metadata.file_name")
    return found.select(F.col("_metadata.file_path").alias("path"), name.alias("file_name"), "length")


def read_page_files(spark: SparkSession, path: str, schema: str = PAGE_FILE, files: str = "*") -> DataFrame:
    """The rows of all Parquet page files that can be read, with ``path`` and ``file_name`` as ``list_files`` has them.

    A file that is damaged, of another format or gone by now is passed over; ``read_outcomes`` tells which.
    """
    if folder := _reached(spark, path, files):
        kinds = StructType.fromDDL(schema)
        wanted = to_arrow_schema(kinds)

        def pages(system: fs.FileSystem, file: str) -> Iterator[pa.RecordBatch]:
            try:
                with system.open_input_file(file) as stream:
                    held = pq.ParquetFile(stream)
                    there = {n.lower(): n for n in held.schema_arrow.names}
                    asked = [there[f.name.lower()] for f in wanted if f.name.lower() in there]
                    for batch in held.iter_batches(BATCH_ROWS, columns=asked):
                        found = [batch.column(there[f.name.lower()]).cast(f.type) if f.name.lower() in there else pa.nulls(batch.num_rows, f.type) for f in wanted]
                        yield pa.RecordBatch.from_arrays(found, schema=wanted)
            except (OSError, pa.ArrowException):
                return

        rows = _read(_listed(spark, folder, files, "file_name"), folder, kinds, pages)
        return rows.select(*kinds.names, "path", F.col("name").alias("file_name"))
    tolerant = spark.read.schema(schema).options(ignoreCorruptFiles=True, ignoreMissingFiles=True, pathGlobFilter=files)
    rows = tolerant.parquet(path)
    name = F.col("file_name") if "file_name" in rows.columns else F.col("_metadata.file_name")
    return rows.withColumns({"path": F.col("_metadata.file_path"), "file_name": name})


def read_text_files(spark: SparkSession, path: str, files: str, key: str) -> DataFrame:
    """Whole text files: path, name, named, value. ``named``: the name is that of a folder ``key=...``, not the file's own.

    Compressed files are read as what they hold.
    """
    if folder := _reached(spark, path, files):

        def texts(system: fs.FileSystem, file: str) -> Iterator[pa.RecordBatch]:
            with system.open_input_stream(file, compression="detect") as stream:
                yield pa.RecordBatch.from_arrays([pa.array([stream.read()], pa.binary())], names=["value"])

        read = _read(_listed(spark, folder, files, key), folder, StructType.fromDDL("value binary"), texts)
        return read.withColumn("value", F.col("value").cast("string"))
    found = spark.read.option("pathGlobFilter", files).text(path, wholetext=True)
    named, file = key in found.columns, F.col("_metadata.file_path")
    name = F.col(key).cast("string") if named else F.substring_index(file, "/", -1)
    return found.select(file.alias("path"), name.alias("name"), F.lit(named).alias("named"), "value")


def read_outcomes(listing: DataFrame, rows: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """file_name, read_error: why nothing came out of a file (or out of one of its parts), null if all were read.

    Spark's listings leave out files without a byte. With ``expected`` (file_name) those, and files that are not there, are told too.
    """
    read = rows.select("path").distinct().withColumn("_read", F.lit(True))
    why = F.when(F.col("_read"), None).otherwise("cannot be read")
    told = listing.join(read, "path", "left").groupBy("file_name").agg(F.max(why).alias("read_error"))
    if expected is None:
        return told
    found = expected.select("file_name").distinct().join(told.withColumn("_listed", F.lit(True)), "file_name", "left")
    return found.select("file_name", F.when(F.col("_listed"), F.col("read_error")).otherwise("empty or missing").alias("read_error"))


def only_pdf(files: DataFrame, path: str = "path") -> DataFrame:
    """The same choice on a table of file names."""
    return files.filter(F.endswith(F.lower(F.col(path)), F.lit(PDF_SUFFIX)))


def scan_regions(regions: DataFrame, payload: str = "img") -> DataFrame:
    """Layout regions without their image payload; dropped first, so that a columnar scan never reads it."""
    return regions.drop(payload)
