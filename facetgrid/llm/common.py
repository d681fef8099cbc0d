"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    A folder of our own is made only where the setting is absent and the session
    is a local one (tests); on a cluster an absent setting is an error, as each
    executor would write to its own disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="facetgrid-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str, max_rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Cuts the lineage: what follows survives lost executors without computing
    this again.  The files go by ``release``, or when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/facetgrid/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("maxRecordsPerFile", max_rows_per_file).option("compression", "zstd").parquet(path)
    where, system = _located(spark, path)
    system.deleteOnExit(where)
    made = spark.read.schema(schema).parquet(path)
    made._facetgrid_path = path
    return made


def _located(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and nothing will read again."""
    for df in tables:
        path = getattr(df, "_facetgrid_path", None)
        if path:
            where, system = _located(df.sparkSession, path)
            system.delete(where, True)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` gives the same on pure ASCII, faster."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
