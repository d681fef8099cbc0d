"""An extension: first-wins ingest as a stream of files.

Each micro-batch appends the codes it is first to bring, so the table of first
rows grows as files arrive, with the outcome of a batch run over the files in
the order of their batches.  Files of one batch are ordered by path, then row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def first_of_batch(rows: DataFrame, code: str) -> DataFrame:
    order = F.struct("_path", "_row")
    return rows.groupBy(code).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in (code, "_path", "_row")]), order).alias("r")).select(code, "r.*")


def start_first_wins(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, code: str = "kogiCd") -> StreamingQuery:
    """Read JSON-lines files as they come; write first rows to Parquet under ``target/batch=N``.

    A batch that runs again after a failure overwrites its own folder only, so
    its outcome is the same.
    """
    stream = spark.readStream.schema(schema).json(source).withColumns({"_path": F.col("_metadata.file_path"), "_row": F.col("_metadata.file_block_start").cast("long")})

    def put(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        numbered = batch.where(F.trim(F.col(code)) != "").withColumn("_row", F.monotonically_increasing_id())
        new = first_of_batch(numbered, code)
        done = session.read.schema(f"{code} string, batch long").option("basePath", target)
        if number:
            known = done.parquet(target).where(F.col("batch") < number).select(code)
            new = new.join(known, code, "left_anti")
        new.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
