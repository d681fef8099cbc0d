"""Crawl outcomes as a stream: the breaker and the report of each run as keyed state.

The state of a run is its counts, the length of its current streak of blocking
outcomes, where its breaker tripped and its first failures, so it does not grow
with the run.  Outcomes of a run must come in order from batch to batch; within
a batch they are put in order.  A timer of event time closes a run that has been
quiet: its last row is sent with ``closed``, and its state goes.

Rows are sent for runs that a batch touched; of a run's rows the one with the
largest ``seen`` counts.  Batches are written to folders of their own, so one
that runs again after a failure changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTCOME = "run string, at long, ts timestamp, status int, reason string, fatal boolean"
STATE = "seen long, streak int, fetched long, skipped long, no_detail long, tripped_at long, said string, timer long"
REPORT = "run string, seen long, fetched long, skipped long, no_detail long, aborted boolean, tripped_at long, diagnostics array<string>, closed boolean"


def blocks(status: int | None) -> bool:
    """As ``incremental.is_blocking``."""
    return status is not None and (status in (403, 429) or 500 <= status <= 599)


class Crawl(StatefulProcessor):
    def __init__(self, n: int, first: int, quiet_ms: int) -> None:
        self.n, self.first, self.quiet_ms = n, first, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("run", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows)).sort_values("at", kind="stable")
        now = self.kept.get() if self.kept.exists() else None
        seen, streak, fetched, skipped, no_detail, tripped, said, timer = now or (0, 0, 0, 0, 0, None, "[]", None)
        said = json.loads(said)
        for row in came.itertuples():
            seen += 1
            if tripped is not None:
                continue  # what comes after the breaker has tripped was never asked for
            status = None if pd.isna(row.status) else int(row.status)
            if status is None and not row.fatal:
                fetched += 1
            else:
                skipped += 1
                no_detail += bool(row.fatal)
                if len(said) < self.first:
                    said.append(row.reason)
            streak = streak + 1 if blocks(status) else 0
            if streak == self.n:
                tripped = int(row.at)
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = int(came["ts"].max().timestamp() * 1000) + self.quiet_ms
        self.handle.registerTimer(timer)
        self.kept.update((seen, streak, fetched, skipped, no_detail, tripped, json.dumps(said), timer))
        yield self._row(key, closed=False)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        if self.kept.exists():
            yield self._row(key, closed=True)
            self.kept.clear()

    def _row(self, key: tuple, closed: bool) -> pd.DataFrame:
        seen, _, fetched, skipped, no_detail, tripped, said, _ = self.kept.get()
        row = (key[0], seen, fetched, skipped, no_detail, tripped is not None, tripped, json.loads(said), closed)
        out = pd.DataFrame([row], columns=["run", "seen", "fetched", "skipped", "no_detail", "aborted", "tripped_at", "diagnostics", "closed"])
        out["tripped_at"] = out["tripped_at"].astype("Int64")
        return out

    def close(self) -> None:
        pass


def reports(outcomes: DataFrame, n: int = 3, first: int = 8, quiet: str = "10 minutes", late: str = "0 seconds") -> DataFrame:
    """A stream of REPORT rows of a stream of OUTCOME rows."""
    quiet_ms = int(pd.Timedelta(quiet).total_seconds() * 1000)
    keyed = outcomes.withWatermark("ts", late).groupBy("run")
    return keyed.transformWithStateInPandas(Crawl(n, first, quiet_ms), outputStructType=REPORT, outputMode="Update", timeMode="EventTime")


def start_reports(outcomes: DataFrame, target: str, checkpoint: str, n: int = 3, first: int = 8, quiet: str = "10 minutes") -> StreamingQuery:
    """Write reports of the outcomes that are there under ``target/batch=N``; the checkpoint says where to go on."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    made = reports(outcomes, n, first, quiet)
    return made.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The last row of each run that was ever reported."""
    rows = spark.read.schema(f"{REPORT}, batch long").option("basePath", target).parquet(target)
    kept = rows.groupBy("run").agg(F.max_by(F.struct("seen", "fetched", "skipped", "no_detail", "aborted", "tripped_at", "diagnostics", "closed"), F.struct("seen", "closed", "batch")).alias("r"))
    return kept.select("run", "r.*")
