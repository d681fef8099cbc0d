"""Point lookup of keyed records with a negative cache.

Records are written as Parquet files that are ranges of keys.  Beside them stand
the range of each file and a Bloom filter of its keys, as bitmap rows.  A lookup
asks these first, and only files that may have one of the keys are opened; if
there is none, nothing is read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetgrid.operators import bitmaps
from facetgrid.operators.dictionaries import small_side

#: Bits of a filter for each key of the largest file, and hashes of a key: about one absent key in 2,000 passes.
BITS_EACH, HASHES = 16, 11


def _probes(key: Column, bits: Column | int) -> Column:
    bits = F.lit(bits) if isinstance(bits, int) else bits
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(k)), bits) for k in range(HASHES)])


@dataclass(frozen=True)
class Lookup:
    """Records under ``path``: ``records``, ``files`` (file, least, most, n, bits) and ``filters`` (file, bucket, bits)."""

    path: str
    key: str

    def files(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/files")

    def may_have(self, keys: DataFrame) -> DataFrame:
        """(key, file): each distinct key with the files whose range and filter it passes."""
        spark = keys.sparkSession
        asked = keys.select(F.col(self.key)).where(F.col(self.key).isNotNull()).distinct()
        # A key lies in the range of one file, or of two that share it.
        ranges = asked.join(small_side(self.files(spark)), (F.col(self.key) >= F.col("least")) & (F.col(self.key) <= F.col("most")))
        probes = ranges.select(self.key, "file", F.explode(F.array_distinct(_probes(F.col(self.key), F.col("bits")))).alias("at"))
        probes = probes.select(self.key, "file", F.bitmap_bucket_number(F.col("at") + 1).alias("bucket"), F.pmod("at", F.lit(bitmaps.BUCKET)).alias("bit"))
        filters = spark.read.parquet(f"{self.path}/filters").withColumnRenamed("bits", "filter")
        tested = probes.join(filters, ["file", "bucket"], "left").select(self.key, "file", F.coalesce(bitmaps.has(F.col("filter"), F.col("bit")), F.lit(False)).alias("set"))
        return tested.groupBy(self.key, "file").agg(F.bool_and("set").alias("all")).where("all").select(self.key, "file")

    def find(self, keys: DataFrame) -> DataFrame:
        """The records of ``keys`` (a frame with the key's column); only files that may have one are opened."""
        spark = keys.sparkSession
        passed = self.may_have(keys)
        names = [r["file"] for r in passed.select("file").distinct().collect()]  # as many as there are files at most
        schema = spark.read.parquet(f"{self.path}/none").schema
        if not names:
            return spark.createDataFrame([], schema)
        read = spark.read.schema(schema).parquet(*[f"{self.path}/records/{n}" for n in sorted(names)])
        return read.join(small_side(passed.select(self.key).distinct()), self.key, "left_semi").select(*schema.names)


def write(records: DataFrame, path: str, key: str, files: int) -> Lookup:
    """Write ``records`` in about ``files`` ranges of ``key``; rows with a null key are left out."""
    spark = records.sparkSession
    rows = records.where(F.col(key).isNotNull())
    rows.repartitionByRange(files, key).sortWithinPartitions(key).write.parquet(f"{path}/records")
    rows.limit(0).write.parquet(f"{path}/none")  # the schema, for lookups that open no file
    read = spark.read.schema(rows.schema).parquet(f"{path}/records")
    named = read.select(F.col(key), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"))
    sizes = named.groupBy("file").agg(F.min(key).alias("least"), F.max(key).alias("most"), F.count("*").alias("n"))
    most = F.ceil(F.col("n") * BITS_EACH / bitmaps.BUCKET) * bitmaps.BUCKET
    sizes.withColumn("bits", most.cast("long")).coalesce(1).write.parquet(f"{path}/files")
    bits = spark.read.parquet(f"{path}/files").select("file", "bits")
    set_bits = named.join(small_side(bits), "file").select("file", F.explode(_probes(F.col(key), F.col("bits"))).alias("at"))
    filters = bitmaps.bitmap_rows(set_bits, "file", "at").withColumnRenamed("value", "file")
    filters.repartition("file").sortWithinPartitions("file", "bucket").write.parquet(f"{path}/filters")
    return Lookup(path, key)
