"""Readers of lenient JSON documents, detail records, tombstones and datasets.

What the order of rows decides (which duplicate wins) is an explicit ordinal:
the position of the file in a list that the caller or a byte-wise sort gives,
and the position in the file.  Partition order plays no part.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from facetgrid.sources.named_files import read_files
from facetgrid.sources.shared import new_path

# The wire schemas.
REQUIRED = ("kogiCd", "kogiNm", "tantoKyoin", "jikanwari", "kogiKaikojikiNm", "kogiKubunNm", "sekininBushoNm", "kochiNm", "gakusokuKamokuNm")
OPTIONAL = ("fukudai", "taishoGakka", "taishoNenji", "kamokuBunrui", "kamokuBunya", "syllabusKomokuPatternId", "kaikoNendo", "lastUpdate")
ENVELOPE = "selectKogiDtoList"
DETAIL = (
    "cd string, lastUpdate string, unit string, delivery struct<mode:string,raw:string,isMedia:boolean>, "
    "eval struct<rows:array<struct<item:string,weight:bigint,type:string>>,note:string>, summary string, aims string, goals array<string>, "
    "plan array<struct<n:bigint,text:string,kind:string>>, textbooks string, prereq string, prep string, "
    "officeHour array<struct<name:string,day:string,time:string,place:string>>, keywords array<string>, teachers array<string>, "
    "numbering array<string>, sdgs array<string>, extra array<struct<label:string,text:string>>, "
    "textbookInfo struct<isNone:boolean,sections:array<struct<label:string,lines:array<string>>>>, prepInfo struct<hours:double,yoshu:string,fukushu:string>"
)
COURSE = (
    "cd string, nm string, sub string, prof string, raw string, slots array<struct<s:int,d:int,p:int>>, ki int, kbn int, dept int, campus int, "
    "gaku string, gakka string, nen string, bunrui string, bunya string, pat string, unit string, dm string, ev array<string>"
)
DATASET = (
    "version int, generatedAt string, year string, totalRaw int, "
    "dicts struct<semesters:array<string>,departments:array<string>,campuses:array<string>,kubun:array<string>,kaikojiki:array<string>>, "
    f"indices struct<semester:array<string>,department:array<string>,campus:array<string>>, courses array<struct<{', '.join(':'.join(f.split(' ', 1)) for f in COURSE.split(', '))}>>"
)
VERSION = 3


class DatasetError(ValueError):
    """A dataset document that cannot be loaded."""


class RawDocument(DatasetError):
    """The document is a raw listing, not a converted dataset."""


class UnsupportedVersion(DatasetError):
    """The document has no version, or one that is not supported."""


def list_files(spark: SparkSession, folder: str, suffix: str = ".json") -> list[str]:
    """Files of a folder by Hadoop's file systems, sorted byte by byte; none if the folder is missing."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath().toString() for s in fs.listStatus(path) if s.isFile()]
    return sorted((f for f in found if f.endswith(suffix)), key=lambda f: f.encode())


def read_texts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file_ord, text): whole files, numbered in the order given."""
    frames = [spark.read.text(p, wholetext=True).select(F.lit(k).alias("file_ord"), F.col("value").alias("text")) for k, p in enumerate(paths)]
    if not frames:
        return spark.createDataFrame([], "file_ord int, text string")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def unwrap(document: Column) -> Column:
    """array<variant> of the records, of an envelope or a bare array; null for anything else."""
    v = F.try_parse_json(document)
    listed = F.try_variant_get(v, f"$.{ENVELOPE}", "array<variant>")
    return F.coalesce(listed, F.try_variant_get(v, "$", "array<variant>"))


def parse_documents(texts: DataFrame) -> DataFrame:
    """(file_ord, item, valid, record string) of documents (file_ord, text).

    A document that is empty, no JSON or no list is an error; a record that is no
    object is only not valid.
    """
    records = F.when(F.trim("text") == "", F.raise_error(F.lit("the input is empty"))).otherwise(
        F.coalesce(unwrap(F.col("text")), F.raise_error(F.concat(F.lit("no list of records in file "), F.col("file_ord").cast("string"))))
    )
    each = texts.select("file_ord", F.posexplode(records).alias("item", "v"))
    return each.select("file_ord", "item", F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")).alias("valid"), F.to_json("v").alias("record"))


def lenient_fields(rows: DataFrame, record: str, required: Sequence[str], optional: Sequence[str] = (), *keep: str) -> DataFrame:
    """(keep..., fields...) of JSON records: every scalar as text, required fields "" where absent or null, others null, unknown keys ignored."""
    schema = ", ".join(f"`{n}` string" for n in (*required, *optional))
    read = rows.select(*keep, F.from_json(record, schema).alias("r"))
    return read.select(*keep, *[F.coalesce(f"r.{n}", F.lit("")).alias(n) for n in required], *[f"r.{n}" for n in optional])


def raw_courses(parsed: DataFrame) -> DataFrame:
    """(file_ord, item, fields...): all as text, required ones "" where absent, unknown keys ignored."""
    return lenient_fields(parsed.where("valid"), "record", REQUIRED, OPTIONAL, "file_ord", "item")


def load_warnings(parsed: DataFrame) -> DataFrame:
    return parsed.where("not valid").select("file_ord", "item", F.concat(F.lit("[item "), (F.col("item") + 1).cast("string"), F.lit("] skipped")).alias("warning"))


def read_courses(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(raw courses, warnings) of files in the order given."""
    parsed = parse_documents(read_texts(spark, paths))
    return raw_courses(parsed), load_warnings(parsed)


def read_course_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return read_courses(spark, list_files(spark, folder))


@F.udf(returnType=StringType(), useArrow=True)
def _decoded(content: bytes) -> str | None:
    """Text of a JSON file, whose first bytes tell its encoding; null if it is none."""
    try:
        return content.decode(json.detect_encoding(content))
    except UnicodeDecodeError:
        return None


def _detail_rows(spark: SparkSession, folder: str, schema: str, strict: bool) -> DataFrame:
    """Records of the JSON files of a folder, an object or a list of them each; broken files are errors or skipped."""
    text = read_files(spark, folder, ".json").select("name", _decoded("content").alias("text"))
    if strict:
        text = text.withColumn("text", F.coalesce("text", F.raise_error(F.concat(F.lit("no text in "), "name"))))
    each = ", ".join(":".join(f.split(" ", 1)) for f in schema.split(", "))
    return text.select(F.inline(F.from_json("text", f"array<struct<{each}>>", {"mode": "FAILFAST" if strict else "PERMISSIVE"})))


def read_details(spark: SparkSession, folder: str) -> DataFrame:
    """Detail records of a folder; any broken file or repeated code is an error.

    The files are read once, and their records kept as Parquet in the shared folder.
    """
    kept = new_path(spark, "details")
    _detail_rows(spark, folder, DETAIL, strict=True).write.parquet(kept)
    rows = spark.read.schema(DETAIL).parquet(kept)
    twice = rows.groupBy("cd").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise DatasetError(f"two detail files for {twice[0]['cd']}")
    return rows


def saved_updates(spark: SparkSession, folder: str) -> DataFrame:
    """(cd, last_update) of what is saved; broken files are skipped, a missing folder is empty."""
    rows = _detail_rows(spark, folder, "cd string, lastUpdate string", strict=False)
    return rows.where("cd is not null").select("cd", F.coalesce("lastUpdate", F.lit("")).alias("last_update"))


def read_tombstones(spark: SparkSession, path: str) -> DataFrame:
    """(cd, last_update, fails) of a tab-separated file; garbled lines are skipped."""
    schema = "cd string, last_update string, fails int"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    parts = spark.read.text(path).select(F.split("value", "\t").alias("c"))
    rows = parts.where(F.size("c") >= 3).select(F.col("c")[0].alias("cd"), F.col("c")[1].alias("last_update"), F.col("c")[2].try_cast("int").alias("fails"))
    return rows.where("cd <> '' and fails >= 0")


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """The one row of a dataset document, after its version is checked."""
    text = spark.read.text(path, wholetext=True)
    v = F.try_parse_json("value")
    has_list = F.try_variant_get(v, f"$.{ENVELOPE}", "variant").isNotNull() | F.startswith(F.schema_of_variant(v), F.lit("ARRAY"))
    head = text.select(v.isNotNull().alias("json"), has_list.alias("raw"), F.try_variant_get(v, "$.version", "int").alias("version")).first()
    if head is None or not head["json"]:
        raise DatasetError("no JSON document")
    if head["raw"]:
        raise RawDocument("a raw listing: convert it first")
    if head["version"] != VERSION:
        raise UnsupportedVersion(f"version {head['version']}; only {VERSION} can be read")
    return text.select(F.from_json("value", DATASET).alias("d")).select("d.*")


def point_lookup(details: DataFrame, code: str) -> DataFrame:
    """At most one row; on Parquet sorted by code the scan reads one row group."""
    return details.where(F.col("cd") == code).limit(1)
