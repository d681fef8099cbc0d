"""Writers: datasets, per-code details, tombstones, indexes, pages, payloads.

What is one file by its format is made in parts by tasks, written as files of a
folder with a manifest, and only then joined, byte after byte, in the order of
the manifest.  No task and no driver holds the whole.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetgrid.operators.search import FIELDS, build_index
from facetgrid.plans.convert import Dataset, document_parts, html_safe, search_fields
from facetgrid.sources.index_codec import encode_rows, header
from facetgrid.sources.named_files import write_files
from facetgrid.sources.shared import located, new_path

MANIFEST = "manifest.jsonl"
#: Rows of a part of a line file or index.
PART_ROWS = 4096


def _delete(spark: SparkSession, path: str) -> None:
    where, system = located(spark, path)
    system.delete(where, True)


def write_parts(parts: DataFrame, folder: str) -> None:
    """Rows (part long, content) as files of ``folder`` and a manifest: a line (part, name, bytes, sha256) for each, in order."""
    name = F.concat(F.lit("part-"), F.lpad(F.col("part").cast("string"), 18, "0"))
    write_files(parts.select(name.alias("name"), F.col("content").cast("binary").alias("content")), folder, overwrite=True)
    files = parts.sparkSession.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    base = F.element_at(F.split("path", "/"), -1)
    line = F.struct(F.substring(base, 6, 18).cast("long").alias("part"), base.alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    lines = files.agg(F.array_sort(F.collect_list(F.struct(base.alias("name"), F.to_json(line).alias("json")))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: F.concat(x["json"], F.lit("\n"))), "")
    write_files(lines.select(F.lit(MANIFEST).alias("name"), text.cast("binary").alias("content")), folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("part long, name string, bytes long, sha256 string").json(f"{folder}/{MANIFEST}")


def join_parts(spark: SparkSession, folder: str, path: str) -> None:
    """One file at ``path`` of the parts in their order, streamed through a small buffer."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where, system = located(spark, path)
    aside, _ = located(spark, f"{path}.aside")
    out = system.create(aside, True)
    try:
        for row in read_manifest(spark, folder).orderBy("part").toLocalIterator():
            part, there = located(spark, f"{folder}/{row['name']}")
            stream = there.open(part)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
            finally:
                stream.close()
    finally:
        out.close()
    system.delete(where, False)
    if not system.rename(aside, where):
        raise OSError(f"{path} cannot be written")


def _joined(parts: DataFrame, path: str) -> None:
    """Parts written by tasks, joined at ``path``, and deleted."""
    spark = parts.sparkSession
    folder = new_path(spark, "parts")
    write_parts(parts, folder)
    join_parts(spark, folder, path)
    _delete(spark, folder)


def ordered_parts(rows: DataFrame, join: Callable[[list], bytes]) -> DataFrame:
    """(part, content) of rows in order (after ``orderBy``): ``join`` makes the bytes of at most PART_ROWS rows; parts follow the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting = TaskContext.get().partitionId() * (1 << 32), []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([join(waiting)], pa.binary())], names=["part", "content"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                waiting.append(row)
                if len(waiting) == PART_ROWS:
                    yield made()
                    part, waiting = part + 1, []
        if waiting:
            yield made()

    return rows.mapInArrow(run, "part long, content binary")


def dataset_parts(data: Dataset, generated_at: str, details: DataFrame | None = None) -> DataFrame:
    return document_parts(data, generated_at, details).select("part", F.encode("text", "UTF-8").alias("content"))


def write_dataset(data: Dataset, path: str, generated_at: str, details: DataFrame | None = None, compact: bool = True) -> None:
    """The dataset document without a newline at its end; nothing is written for no courses."""
    if data.courses.isEmpty():
        raise ValueError("no courses")
    if compact:
        _joined(dataset_parts(data, generated_at, details), path)
        return
    # The indented form is for reading by eye: a catalogue that fits one value.
    parts = document_parts(data, generated_at, details).orderBy("part").toLocalIterator()
    pretty = json.dumps(json.loads("".join(r["text"] for r in parts)), ensure_ascii=False, indent=2)
    text = data.courses.sparkSession.range(1).select(F.lit(0).cast("long").alias("part"), F.encode(html_safe(F.lit(pretty)), "UTF-8").alias("content"))
    _joined(text, path)


def index_parts(index: DataFrame) -> DataFrame:
    """(part, content) of the binary exchange form: its header, then the rows (idx, fields) by position."""
    rows = index.orderBy("idx").select(*FIELDS)
    body = ordered_parts(rows, encode_rows)
    count = F.lpad(F.hex("n"), 8, "0")  # four bytes, the lowest first
    head = F.concat(F.lit(header(0)[:-4]), F.unhex(F.concat(*[F.substring(count, at, 2) for at in (7, 5, 3, 1)])))
    first = index.agg(F.count("*").alias("n")).select(F.lit(-1).cast("long").alias("part"), head.alias("content"))
    return first.unionByName(body).withColumn("part", F.col("part") + 1)


def write_index(data: Dataset, path: str, details: DataFrame | None = None, binary: bool = False) -> None:
    """The folded fields as Parquet, or in the binary exchange form."""
    fields = search_fields(data.courses, details)
    index = build_index(fields, "idx", {f: F.col(f) for f in FIELDS})
    if not binary:
        index.write.parquet(path)
        return
    _joined(index_parts(index), path)


def detail_json(columns: list[str]) -> Column:
    """Compact JSON, null fields left out."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]))


def write_details(details: DataFrame, path: str) -> None:
    """``{cd}.json`` for each code; files with the same bytes are not touched, those of other codes stay."""
    rows = details.select(F.concat("cd", F.lit(".json")).alias("name"), F.encode(detail_json(details.columns), "UTF-8").alias("content"))
    write_files(rows, path)


def write_pages(pages: DataFrame, path: str, keep: str = "[!p]*") -> None:
    """Rows (name, content) as they are; pages that are there and not among the rows go, as do no files whose names match ``keep``."""
    write_files(pages, path, overwrite=True, keep=keep)


def write_tombstones(state: DataFrame, path: str) -> None:
    """Sorted lines of code, update and failures; an empty state removes the file."""
    if state.isEmpty():
        _delete(state.sparkSession, path)
        return
    line = F.concat_ws("\t", "cd", F.coalesce("last_update", F.lit("")), F.col("fails").cast("string"))
    lines = state.orderBy("cd").select(F.concat(line, F.lit("\n")).alias("line"))
    _joined(ordered_parts(lines, lambda rows: "".join(r[0] for r in rows).encode()), path)


def commit_payload(changes: DataFrame, files: DataFrame) -> DataFrame:
    """(path, action, contents): base64 of each addition, from (path, content) rows."""
    plain = F.regexp_replace(F.base64("content"), "[\r\n]", "")
    return changes.join(files, "path", "left").select("path", "action", F.when(F.col("action") == "add", plain).alias("contents"))
