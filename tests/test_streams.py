"""Crawl outcomes as a stream against the batch operators, over batches and restarts."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from facetgrid.operators import incremental
from facetgrid.streaming import crawl

START = datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC)


def outcomes(rng, n):
    kinds = [(None, "", False), (403, "HTTP 403", False), (404, "HTTP 404", False), (None, "no guid", True), (503, "HTTP 503", False), (429, "HTTP 429", False)]
    return [(f"r{rng.randrange(6)}", k, START + datetime.timedelta(seconds=k), *rng.choices(kinds, weights=[6, 3, 2, 1, 2, 1])[0]) for k in range(n)]


@pytest.fixture
def state_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_a_stream_gives_what_the_batch_gives(spark, tmp_path, state_store):
    rows = outcomes(random.Random(21), 120)
    source, target, checkpoint = (str(tmp_path / d) for d in ("in", "out", "check"))
    write = lambda part: spark.createDataFrame(part, crawl.OUTCOME).coalesce(1).write.mode("append").parquet(source)
    run = lambda: crawl.start_reports(spark.readStream.schema(crawl.OUTCOME).option("maxFilesPerTrigger", 1).parquet(source), target, checkpoint, first=3, quiet="30 seconds").awaitTermination()
    for part in (rows[:50], rows[50:80], rows[80:]):  # each call is a restart from the checkpoint
        write(part)
        run()
    batch = spark.createDataFrame(rows, crawl.OUTCOME).drop("ts")
    want = incremental.crawl_report(batch, "run", "at", 3, first=3)
    columns = ["run", "fetched", "skipped", "no_detail", "aborted", "diagnostics"]
    got = crawl.latest(spark, target)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    trips = incremental.breaker(batch, "run", "at", F.coalesce(incremental.is_blocking(F.col("status")), F.lit(False)), 3)
    assert sorted(map(tuple, got.where("aborted").select("run", "tripped_at").collect())) == sorted(map(tuple, trips.collect()))
    assert got.agg(F.sum("seen")).first()[0] == len(rows)
    # A run that is quiet is closed once the others have gone on for long enough.
    write([("other", 1000, START + datetime.timedelta(hours=1), None, "", False)])
    run()
    write([("other", 1001, START + datetime.timedelta(hours=2), None, "", False)])
    run()
    closed = crawl.latest(spark, target).where("closed").select("run")
    assert {r["run"] for r in closed.collect()} >= {r[0] for r in rows}
    assert crawl.latest(spark, target).agg(F.sum("seen")).first()[0] == len(rows) + 2


def test_pages_as_a_stream(spark, tmp_path):
    import json

    from facetgrid.sources.paged import PagedSource

    spark.dataSource.register(PagedSource)
    folder, target, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()
    page = lambda n, rows, most=5: json.dumps({"pageNo": n, "maxPageNo": most, "total": 9, "rows": [{"a": r} for r in rows]})
    put = lambda n, text: (folder / ("page.json" if n == 1 else f"page-{n:02d}.json")).write_text(text)
    batches = []

    def keep(batch, number):
        batches.append(sorted({r["page"] for r in batch.select("page").collect()}))
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    def run():
        stream = spark.readStream.format("pages").option("pages_each", 2).load(str(folder))
        query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(processingTime="200 milliseconds").start()
        try:
            query.processAllAvailable()
        except Exception as e:  # what the source said
            return str(e)
        finally:
            query.stop()
        return None

    for n in (1, 2, 3):
        put(n, page(n, [2 * n - 1, 2 * n]))
    assert run() is None  # page 4 is not there yet
    put(4, page(4, [7]))  # not full: the stop leaves the offset where it was
    assert "is not full" in run()
    put(4, page(4, [7, 8]))
    put(5, page(5, [9]))
    assert run() is None
    assert [p for b in batches for p in b] == [1, 2, 3, 4, 5]
    rows = spark.read.parquet(target).orderBy("page", "item").collect()
    assert [json.loads(r["record"])["a"] for r in rows] == list(range(1, 10))
