"""A Spark data source that writes rows (name, content) as files, all or none, and reads them.

    spark.dataSource.register(NamedFiles)
    df.write.format("named_files").option("path", folder).mode("append").save()
    spark.read.format("named_files").option("path", folder).option("suffix", ".json").load()

Each task writes beside the folder's files, in a place of its own attempt, and
skips a file that stands there with the same bytes.  When all tasks are done the
files move to their names; if one fails, or a name comes twice, what was written
aside goes and the folder is as before.  With the mode "overwrite", files that
the rows do not name are deleted in the end (``keep`` is a pattern of names that
stay).  Paths are local ones or URIs that Arrow's file systems know.

A read lists the folder once, its subfolders aside, and deals the names to tasks;
each opens its own files.  Spark's readers hold a status and plan a split for each
file, which a folder with a file for each code has too many of.
"""

from __future__ import annotations

import fnmatch
import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from facetgrid.sources.shared import located

ASIDE = ".aside-"
#: Files of a reading task at most, and at least unless tasks would be idle; files and bytes of a batch.
FILES, FEW, BATCH_FILES, BATCH_BYTES = 16384, 64, 1024, 4 << 20


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote in ``place``, and what it found there already."""

    place: str
    names: list[str]
    same: list[str]


def checked(name: str | None) -> str:
    parts = (name or "").split("/")
    if not name or name.startswith("/") or any(p in ("", ".", "..") or p.startswith(ASIDE) for p in parts):
        raise ValueError(f"no name for a file: {name!r}")
    return name


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if [f.name for f in schema.fields] != ["name", "content"]:
            raise ValueError("the rows must be (name, content)")
        return Writer(self.options["path"], overwrite, self.options.get("keep"))

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options["path"], self.options.get("suffix", ""), int(self.options.get("tasks", "1")))


@dataclass
class Share(InputPartition):
    """Names of the files that one task reads."""

    names: list[str]


class Reader(DataSourceReader):
    def __init__(self, path: str, suffix: str, tasks: int) -> None:
        self.path, self.suffix, self.tasks = path, suffix, tasks

    def partitions(self) -> list[InputPartition]:
        system, root = fs.FileSystem.from_uri(self.path)
        names = sorted(n for n in _listed(system, root) if n.endswith(self.suffix))
        count = max(1, -(-len(names) // FILES), min(self.tasks, -(-len(names) // FEW)))
        size = max(1, -(-len(names) // count))
        return [Share(names[at : at + size]) for at in range(0, len(names), size)] or [Share([])]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(self.path)
        names, contents, held = [], [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["name", "content"])

        for name in partition.names:
            with system.open_input_stream(posixpath.join(root, name), compression=None) as file:
                content = file.read()
            names.append(name)
            contents.append(content)
            held += len(content)
            if len(names) == BATCH_FILES or held >= BATCH_BYTES:
                yield made()
                names, contents, held = [], [], 0
        if names:
            yield made()


def _listed(system: fs.FileSystem, root: str) -> Iterator[str]:
    """Names of the files right in a folder; none if it is missing."""
    if not isinstance(system, fs.LocalFileSystem):
        yield from (i.base_name for i in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.type == fs.FileType.File)
    elif os.path.isdir(root):
        with os.scandir(root) as found:  # no status of each file
            yield from (f.name for f in found if f.is_file())


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, keep: str | None) -> None:
        self.path, self.overwrite, self.keep = path, overwrite, keep
        self.job = uuid.uuid4().hex

    def _system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = self._system()
        task = TaskContext.get()
        place = posixpath.join(root, ASIDE + self.job, str(task.taskAttemptId()) if task else "0")
        names, same, made = [], [], set()
        for batch in iterator:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                name = checked(name)
                content = content.as_py()
                data = content.encode() if isinstance(content, str) else content or b""
                if _holds(system, posixpath.join(root, name), data):
                    same.append(name)
                    continue
                target = posixpath.join(place, name)
                if (folder := posixpath.dirname(target)) not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(target) as out:
                    out.write(data)
                names.append(name)
        return Written(place, names, same)

    def commit(self, messages: list[Written]) -> None:
        system, root = self._system()
        done = [m for m in messages if m]
        named: set[str] = set()
        for m in done:
            for name in (*m.names, *m.same):
                if name in named:
                    raise ValueError(f"two rows for {name}")
                named.add(name)
        system.create_dir(root, recursive=True)
        for m in done:
            for name in m.names:
                target = posixpath.join(root, name)
                if "/" in name:
                    system.create_dir(posixpath.dirname(target), recursive=True)
                system.move(posixpath.join(m.place, name), target)
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
                name = posixpath.relpath(info.path, root)
                if info.type == fs.FileType.File and name not in named and not name.startswith(ASIDE) and not (self.keep and fnmatch.fnmatch(name, self.keep)):
                    system.delete_file(info.path)
        self._clean(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*self._system())

    def _clean(self, system: fs.FileSystem, root: str) -> None:
        aside = posixpath.join(root, ASIDE + self.job)
        if system.get_file_info(aside).type == fs.FileType.Directory:
            system.delete_dir(aside)


def _holds(system: fs.FileSystem, path: str, data: bytes) -> bool:
    info = system.get_file_info(path)
    if info.type != fs.FileType.File or info.size != len(data):
        return False
    with system.open_input_stream(path) as there:
        return there.read() == data


def read_files(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """(name, content) of the files of a folder whose names end so; none if it is missing."""
    where, system = located(spark, folder)
    if not system.exists(where):
        return spark.createDataFrame([], "name string, content binary")
    uri = system.makeQualified(where).toUri().toASCIIString()
    try:
        fs.FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, OSError):  # a file system that only Hadoop knows
        read = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
        return read.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    spark.dataSource.register(NamedFiles)
    return spark.read.format("named_files").option("path", uri).option("suffix", suffix).option("tasks", spark.sparkContext.defaultParallelism).load()


def write_files(rows, path: str, overwrite: bool = False, keep: str | None = None) -> None:
    """Write the frame's rows (name, content) at ``path``."""
    rows.sparkSession.dataSource.register(NamedFiles)
    w = rows.select("name", rows.content.cast("binary").alias("content")).write.format("named_files").option("path", path)
    (w.option("keep", keep) if keep else w).mode("overwrite" if overwrite else "append").save()
