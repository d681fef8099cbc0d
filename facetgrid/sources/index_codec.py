"""The binary form of a search index: magic, version, count, then five strings a document.

The native index is a Parquet table of folded fields; this form is for exchange.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The header.
MAGIC, VERSION, FIELDS = b"SYX1", 1, 5


class IndexFormatError(ValueError):
    """Bytes that are no readable index."""


def header(count: int) -> bytes:
    return MAGIC + struct.pack("<HI", VERSION, count)


def encode_rows(rows: Iterable[tuple[str, ...]]) -> bytes:
    """Documents as they follow the header."""
    out = []
    for row in rows:
        if len(row) != FIELDS:
            raise ValueError(f"{len(row)} fields")
        for text in row:
            raw = text.encode()
            out += [struct.pack("<I", len(raw)), raw]
    return b"".join(out)


def encode_index(docs: Iterable[tuple[str, ...]]) -> bytes:
    rows = list(docs)
    return header(len(rows)) + encode_rows(rows)


def decode_index(data: bytes) -> list[tuple[str, ...]]:
    """Documents of an index; bytes after the last one are not looked at."""
    if data[:4] != MAGIC:
        raise IndexFormatError("bad magic")
    if len(data) < 10:
        raise IndexFormatError("truncated")
    version, count = struct.unpack_from("<HI", data, 4)
    if version != VERSION:
        raise IndexFormatError(f"unsupported version {version}")
    return decode_rows(data, 10, count)


def decode_rows(data: bytes, at: int = 0, count: int | None = None) -> list[tuple[str, ...]]:
    """``count`` documents from ``at`` on, or all up to the end."""
    out = []
    while at < len(data) if count is None else len(out) < count:
        row = []
        for _ in range(FIELDS):
            if at + 4 > len(data):
                raise IndexFormatError("truncated")
            (size,) = struct.unpack_from("<I", data, at)
            at += 4
            if at + size > len(data):
                raise IndexFormatError("truncated")
            try:
                row.append(data[at : at + size].decode())
            except UnicodeDecodeError as e:
                raise IndexFormatError("bad UTF-8") from e
            at += size
        out.append(tuple(row))
    return out


def read_index_parts(spark: SparkSession, folder: str) -> DataFrame:
    """(idx, fields) of an index written in parts, each part read by a task of its own.

    Part 0 is the header.  The manifest gives each part's rows their place: parts
    before a part have as many rows as it says, which are counted first.
    """
    names = ("name", "subtitle", "instructor", "code", "keywords")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    base = F.element_at(F.split("path", "/"), -1)
    parts = files.select(F.substring(base, 6, 18).cast("long").alias("part"), "content")
    schema = "part long, at long, " + ", ".join(f"{n} string" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = decode_rows(content.as_py())
                columns = [pa.array([r[k] for r in rows], pa.string()) for k in range(FIELDS)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int64()), *columns], names=["part", "at", *names])

    head = parts.where("part = 0").select("content").first()
    if head is None:
        raise IndexFormatError("no header")
    decode_index(bytes(head["content"])[:4] + bytes(head["content"])[4:6] + bytes(4))  # magic and version
    rows = parts.where("part > 0").mapInArrow(run, schema)
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))  # a row for each part
    start = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    return rows.join(F.broadcast(start), "part").select((F.col("start") + F.col("at")).alias("idx"), *names)
