"""Documents as files: one file per document out (B5, B8), discovery and listed files in.

``DocumentFiles`` is a Spark data source (``spark.dataSource.register``). Its writer puts every row's content into the file its
``out_path`` names, in tasks: a task writes into a staging folder of its own and moves the files to their names when all its
rows are written, so a task that is killed leaves nothing under its names and a repeated one writes the same again;
the staging folder goes when the job commits or aborts. Its reader takes a folder (any depth, extensions in any
case), deals the files out by size and gives every file a status instead of ending the job. ``listed_documents`` does
the same for names that are themselves a DataFrame. Storage is opened through pyarrow's file systems, by the scheme
of the path; a bare path is local, which only a local master or a shared mount may use.

A folder may hold millions of files, so tasks list it (``discovered``) and the names stay a table, which tasks read again:
the driver holds folders' and parts' counts, no names of files.
"""

from __future__ import annotations

import contextlib
import os
import posixpath
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import shared_dir, ship_package

#: What readers of this module give per file.
DOCUMENT_SCHEMA = "path string, src_bytes bigint, content string, status string"
_DOCUMENT = pa.schema([("path", pa.string()), ("src_bytes", pa.int64()), ("content", pa.string()), ("status", pa.string())])
#: Bytes of files, and number of files, that one reading task is given.
PART_BYTES, PART_FILES = 32 << 20, 8192
#: Files, and bytes of them, that a task hands on at once.
BATCH_FILES, BATCH_BYTES = 64, 4 << 20
#: What is in a folder; rows of it that a task hands on at once; tasks that list one level of folders at most.
LISTING_SCHEMA = "place string, size bigint, folder boolean"
_LISTING = pa.schema([("place", pa.string()), ("size", pa.int64()), ("folder", pa.bool_())])
LISTING_ROWS, LISTING_TASKS = 8192, 1024


def open_storage(path: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it) of a path with or without a scheme."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return pafs.LocalFileSystem(), path


def _document(fs: pafs.FileSystem, place: str) -> tuple[int | None, str | None, str]:
    """(bytes, text, status) of one file; bytes that are no UTF-8 become U+FFFD."""
    try:
        with fs.open_input_stream(place) as stream:
            raw = stream.read()
    except FileNotFoundError:
        return None, None, "missing"
    except OSError:
        kind = fs.get_file_info(place).type
        return None, None, "missing" if kind == pafs.FileType.NotFound else "unreadable"
    try:
        return len(raw), raw.decode(), "ok"
    except UnicodeDecodeError:
        return len(raw), raw.decode(errors="replace"), "repaired"


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int, most_bytes: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows as batches of so many rows, and of so many bytes by their second column."""
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += row[1] or 0
        if len(part) == most or (most_bytes and size >= most_bytes):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema, strict=True)], schema=schema)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema, strict=True)], schema=schema)


def _listed(fs: pafs.FileSystem, folder: str, wanted: Callable[[str], bool], entered: Callable[[str], bool]) -> Iterator[tuple]:
    """(place, size, folder) of the wanted files and the folders to enter that lie in a folder; what goes meanwhile is
    left out. A local folder is never held as a whole."""
    if not isinstance(fs, pafs.LocalFileSystem):
        for info in fs.get_file_info(pafs.FileSelector(folder)):
            if info.type == pafs.FileType.Directory and entered(info.base_name):
                yield info.path, None, True
            elif info.type == pafs.FileType.File and wanted(info.base_name):
                yield info.path, info.size, False
        return
    with os.scandir(folder) as entries:
        for entry in entries:
            if entry.is_dir():
                if entered(entry.name):
                    yield entry.path, None, True
            elif wanted(entry.name) and entry.is_file():
                with contextlib.suppress(FileNotFoundError):
                    yield entry.path, entry.stat().st_size, False


def is_folder(root: str) -> bool:
    """Whether pyarrow's file systems open this path, and it is a folder."""
    try:
        fs, place = open_storage(root)
        return fs.get_file_info(place).type == pafs.FileType.Directory
    except (OSError, pa.ArrowException):
        return False


def discovered(spark: SparkSession, root: str, wanted: Callable[[str], bool], entered: Callable[[str], bool]) -> DataFrame:
    """(place, size) of the files below a folder, any depth, whose names are wanted, dealt out for reading by size and number;
    folders whose names are not to be entered are left out with all they hold.

    Tasks list the folders level by level into tables in the shared folder; the driver sees the counts only."""
    ship_package(spark)
    place = open_storage(root)[1]
    top = place.rstrip("/") or place

    def run(batches):
        fs, _ = open_storage(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                try:
                    yield from _batches(_listed(fs, folder, wanted, entered), _LISTING, LISTING_ROWS)
                except FileNotFoundError:  # a folder below that is gone since it was listed
                    if folder == top:
                        raise

    folders = spark.createDataFrame([(top,)], "place string")
    levels, files, size = [], 0, 0
    while folders is not None:
        levels.append(shared_dir(spark, "listing"))
        folders.mapInArrow(run, LISTING_SCHEMA).write.parquet(levels[-1])
        level = spark.read.schema(LISTING_SCHEMA).parquet(levels[-1])
        count, below, total = level.agg(F.count_if(~F.col("folder")), F.count_if("folder"), F.sum("size")).first()
        files, size = files + count, size + (total or 0)
        folders = level.where("folder").select("place").repartition(min(below, LISTING_TASKS)) if below else None
    parts = max(1, -(-size // PART_BYTES), -(-files // PART_FILES))
    found = spark.read.schema(LISTING_SCHEMA).parquet(*levels).where(~F.col("folder"))
    return found.select("place", "size").repartition(parts, "place")


def file_bytes(files: DataFrame, root: str) -> DataFrame:
    """(place, size, content) of discovered files: their bytes as they are. A file that cannot be read ends the job."""

    def contents(fs, places):
        for place in places:
            with fs.open_input_stream(place, compression=None) as stream:
                raw = stream.read()
            yield place, len(raw), raw

    def run(batches):
        fs, _ = open_storage(root)
        schema = pa.schema([("place", pa.string()), ("size", pa.int64()), ("content", pa.binary())])
        for batch in batches:
            yield from _batches(contents(fs, batch.column(0).to_pylist()), schema, BATCH_FILES, BATCH_BYTES)

    return files.select("place").mapInArrow(run, "place string, size bigint, content binary")


class _Files(InputPartition):
    """Files of one task: their places, or a file that has them as its column ``place``."""

    def __init__(self, places: list[str], listing: str | None = None):
        self.places, self.listing = places, listing


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.listing = options["path"], options.get("listing")
        self.wanted = _by_extension(options.get("extensions", "md"))

    def partitions(self) -> list[_Files]:
        if self.listing:
            fs, place = open_storage(self.listing)
            return [_Files([], x.path) for x in fs.get_file_info(pafs.FileSelector(place)) if x.base_name.endswith(".parquet")] or [_Files([])]
        fs, root = open_storage(self.root)
        parts, part, size = [], [], 0
        for info in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
            if info.type == pafs.FileType.File and self.wanted(info.base_name):
                if part and size + info.size > PART_BYTES:
                    parts.append(_Files(part))
                    part, size = [], 0
                part.append(info.path)
                size += info.size
        return [*parts, _Files(part)]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        fs, _ = open_storage(self.root)
        places = partition.places
        if partition.listing:
            with open_storage(self.listing)[0].open_input_file(partition.listing) as f:
                places = pq.read_table(f, columns=["place"]).column(0).to_pylist()
        yield from _batches(((place, *_document(fs, place)) for place in places), _DOCUMENT, BATCH_FILES, BATCH_BYTES)


def _by_extension(extensions: str) -> Callable[[str], bool]:
    """Whether a file's name ends with one of the extensions, in any case, and is not hidden."""
    ends = tuple("." + x.strip().lower() for x in extensions.split(","))
    return lambda name: not name.startswith((".", "_")) and name.lower().endswith(ends)


class _Written(WriterCommitMessage):
    def __init__(self, files: int, size: int):
        self.files, self.size = files, size


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.staging = f"{self.root}/.staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> _Written:
        fs, root = open_storage(self.root)
        staging = posixpath.join(open_storage(self.staging)[1], uuid.uuid4().hex)
        fs.create_dir(staging, recursive=True)
        names, size = [], 0
        for row in rows:
            name = posixpath.normpath(row["out_path"] or "")
            if name.startswith(("/", "..")) or name == ".":
                raise ValueError(f"not a path below the target folder: {row['out_path']!r}")
            content = row["content"]
            raw = content.encode() if isinstance(content, str) else bytes(content or b"")
            with fs.open_output_stream(f"{staging}/{len(names)}") as out:
                out.write(raw)
            names.append(name)
            size += len(raw)
        for folder in {posixpath.dirname(n) for n in names}:
            fs.create_dir(posixpath.join(root, folder), recursive=True)
        for i, name in enumerate(names):
            fs.move(f"{staging}/{i}", posixpath.join(root, name))
        fs.delete_dir(staging)
        return _Written(len(names), size)

    def _clear(self) -> None:
        fs, staging = open_storage(self.staging)
        if fs.get_file_info(staging).type != pafs.FileType.NotFound:
            fs.delete_dir(staging)

    def commit(self, messages: list) -> None:
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()


class DocumentFiles(DataSource):
    """Format ``document_files``: option ``path``; reading also ``extensions``, comma-separated, and ``listing``, a folder of
    Parquet files whose column ``place`` has the files to read, a task for each. Without it the driver lists ``path``
    and holds the names of all files."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return DOCUMENT_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("document files are added to a folder, never put in its place")
        return _Writer(self.options)


def write_documents(documents: DataFrame, root: str) -> None:
    """One file per row of (out_path below ``root``, content: text or bytes). Names must be unique (``one_per_path``)."""
    spark = documents.sparkSession
    ship_package(spark)
    spark.dataSource.register(DocumentFiles)
    documents.select("out_path", "content").write.format("document_files").mode("append").option("path", root).save()


def read_documents(spark: SparkSession, root: str, extensions: str = "md") -> DataFrame:
    """(path, src_bytes, content, status) of the files below ``root`` with one of the extensions."""
    ship_package(spark)
    spark.dataSource.register(DocumentFiles)
    reader = spark.read.format("document_files").option("path", root).option("extensions", extensions)
    if is_folder(root):
        listing = shared_dir(spark, "listing")
        discovered(spark, root, _by_extension(extensions), lambda name: True).write.parquet(listing)
        if is_folder(listing):  # else a store that only Spark reads
            reader = reader.option("listing", listing)
    return reader.load()


def listed_documents(names: DataFrame, path: str = "path") -> DataFrame:
    """(path, src_bytes, content, status) of the files a DataFrame names; a name without a file has status ``missing``."""
    ship_package(names.sparkSession)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                found = []
                for name in batch.column(0).slice(at, 64).to_pylist():
                    found.append((name, *(_document(*open_storage(name)) if name else (None, None, "missing"))))
                columns = [pa.array(c, k) for c, k in zip(zip(*found), (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "src_bytes", "content", "status"])

    return names.select(F.col(path).alias("path")).mapInArrow(run, DOCUMENT_SCHEMA)
