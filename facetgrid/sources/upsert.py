"""Keyed state in buckets, changed by copy on write.

Rows are dealt to ``count`` buckets by a hash of their key.  A batch is merged
with the rows of the buckets that it touches; only these are written again, to
folders of the new version, and a manifest says which folder each bucket has.
The manifest is written last and counts once it is complete, so a batch that
fails, or runs again, leaves the state as it was before or makes it as it should
be.  ``merge`` takes old and new rows together and gives one row for each key;
if it does not depend on how rows are split into batches, neither does the state.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetgrid.sources.shared import located

BUCKET = "_bucket"


@dataclass(frozen=True)
class BucketedState:
    """State under ``path``, keyed by ``key``, of rows with the DDL ``schema``."""

    path: str
    key: str
    schema: str
    count: int = 64

    def version(self, spark: SparkSession) -> int:
        """The last complete version; 0 before the first batch."""
        where, system = located(spark, f"{self.path}/manifest")
        if not system.exists(where):
            return 0
        done = [s.getPath() for s in system.listStatus(where)]
        return max((int(p.getName()) for p in done if system.exists(located(spark, f"{p.toString()}/_SUCCESS")[0])), default=0)

    def folders(self, spark: SparkSession) -> dict[int, str]:
        """Bucket -> its folder; at most ``count`` of them."""
        at = self.version(spark)
        if not at:
            return {}
        return {r["bucket"]: r["folder"] for r in spark.read.parquet(f"{self.path}/manifest/{at:08d}").collect()}

    def _read(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        if not folders:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in sorted(folders)])

    def read(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, list(self.folders(spark).values()))

    def upsert(self, batch: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Merge a batch; the buckets that were written again.  ``batch`` is read twice."""
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.count)).cast("int")
        touched = sorted(r[0] for r in batch.select(bucket).distinct().collect())
        if not touched:
            return []
        at, before = self.version(spark) + 1, self.folders(spark)
        old = self._read(spark, [before[b] for b in touched if b in before])
        merged = merge(old.unionByName(batch.select(*old.columns))).select(*old.columns).withColumn(BUCKET, bucket)
        data = f"data/{at:08d}"
        merged.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/{data}")
        where, system = located(spark, f"{self.path}/{data}")
        names = [s.getPath().getName() for s in system.listStatus(where) if s.isDirectory()]
        now = {b: f for b, f in before.items() if b not in touched} | {int(n.split("=")[1]): f"{data}/{n}" for n in names if n.startswith(f"{BUCKET}=")}
        rows = spark.createDataFrame(sorted(now.items()), "bucket int, folder string")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{at:08d}")
        return touched
