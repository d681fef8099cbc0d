"""Connected components of a graph, by DataFrame joins, and joins that split hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetgrid.llm.common import fresh, materialize, release

#: A key with more than this share of the rows is hot; so there are at most 256 of them.
HOT_SHARE = 256


def split_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner", least: int = 64) -> DataFrame:
    """``big`` joined with ``small`` (one row for each key) without gathering a hot key's rows in one task.

    Keys with more than a 256th of the rows of ``big`` (and more than ``least``)
    are found by a count that combines before its shuffle.  Their rows meet a
    broadcast of their at most 256 rows of ``small``; all others are shuffled.
    """
    counts = big.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    hot = [r[0] for r in counts.where(F.col("n") > max(big.count() // HOT_SHARE, least)).select(key).collect()]
    if not hot:
        return big.join(small, key, how)
    (mark,) = fresh(big.join(small.limit(0), key, "left"), "hot")
    marks = big.sparkSession.createDataFrame([(h,) for h in hot], big.select(key).schema).withColumn(mark, F.lit(True))
    marked = big.join(F.broadcast(marks), key, "left")
    few = small.join(F.broadcast(marks.select(key)), key, "left_semi")
    often = marked.where(mark).drop(mark).join(F.broadcast(few), key, how)
    return often.unionByName(marked.where(F.col(mark).isNull()).drop(mark).join(small, key, how))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, root) for all ids of ``edges`` (a, b): root is the smallest id reachable.

    Large-star and small-star steps in turn, each a minimum per id (combined
    before the shuffle) joined back with hot ids split; every round is written to
    the shared folder and the one before it deleted.  The rounds grow with the
    logarithm of the longest chain; more than ``rounds`` of them are an error.
    """
    now = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(now, "edges")
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = materialize(split_join(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = split_join(large, low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        new = materialize(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a != b").distinct(), "edges")
        release(now, large)
        now = new
        # Done when each id has one edge, to a root that has none.
        inner = now.groupBy("a").agg(F.count("*").alias("n"))
        if not inner.where("n > 1").limit(1).count() and not now.select("b").distinct().join(inner.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count():
            break
    else:
        raise RuntimeError(f"no end after {rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
