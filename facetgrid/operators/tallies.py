"""Credit tallies on several axes, shares, cumulative arcs and top categories."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def credit_axes(courses: DataFrame, axes: tuple[str, ...] = ("kubun", "bunrui", "nen"), credit: str = "credit", keep_empty: tuple[str, ...] = ("kubun",)) -> DataFrame:
    """(axis, key, credits float, count): one pass over all axes by grouping sets, and the totals as axis "total".

    A null credit adds nothing but counts.  An empty or null key counts for the
    axes in ``keep_empty`` only.
    """
    rows = courses.select(*[F.coalesce(F.col(a), F.lit("")).alias(a) for a in axes], F.col(credit).cast("double").alias("_credit"))
    sets = [[F.col(a)] for a in axes] + [[]]
    sums = rows.groupingSets(sets, *axes).agg(
        F.coalesce(F.sum("_credit"), F.lit(0.0)).cast("float").alias("credits"), F.count("*").alias("count"), F.grouping_id(*axes).alias("_gid"),
        F.count(F.when(F.col("_credit").isNull(), 1)).alias("uncredited"),
    )
    full = (1 << len(axes)) - 1
    axis, key, keep = F.when(F.col("_gid") == full, "total"), F.when(F.col("_gid") == full, ""), F.col("_gid") == full
    for k, a in enumerate(axes):
        gid = full & ~(1 << (len(axes) - 1 - k))
        axis, key = axis.when(F.col("_gid") == gid, a), key.when(F.col("_gid") == gid, F.col(a))
        keep = keep | ((F.col("_gid") == gid) & (F.lit(a in keep_empty) | (F.col(a) != "")))
    return sums.where(keep).select(axis.alias("axis"), key.alias("key"), "credits", "count", "uncredited")


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


def shares(rows: DataFrame, group: str, weight: str) -> DataFrame:
    """``rows`` with pct and has_weight: the weight's share of its group, or equal shares where no weight is."""
    w = W.partitionBy(group)
    total = F.sum(F.coalesce(F.col(weight), F.lit(0))).over(w)
    value = F.when(total > 0, F.coalesce(F.col(weight), F.lit(0)) / total).otherwise(F.lit(1) / F.count("*").over(w))
    return rows.select("*", half_up(value * 100).alias("pct"), (total > 0).alias("has_weight"))


def by_type(segments: DataFrame, group: str, kind: str, order: str) -> DataFrame:
    """(group, kind, pct, first): shares summed by kind; ``first`` keeps the order of ties."""
    return segments.groupBy(group, kind).agg(F.sum("pct").alias("pct"), F.min(order).alias("first"))


def top_type(sums: DataFrame, group: str, kind: str) -> DataFrame:
    """(group, kind, pct, tie): the largest kind, and whether the second equals it."""
    w = W.partitionBy(group).orderBy(F.desc("pct"), "first")
    ranked = sums.select(group, kind, "pct", F.row_number().over(w).alias("_at"), F.lead("pct").over(w).alias("_next"))
    return ranked.where("_at = 1").select(group, kind, "pct", F.coalesce(F.col("_next") == F.col("pct"), F.lit(False)).alias("tie"))


def running_before(df: DataFrame, group: str, value: str, *order: Column | str) -> Column:
    """Sum of the rows before, 0 for the first."""
    w = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def arcs(segments: DataFrame, group: str, radius: float, *order: Column | str) -> DataFrame:
    """With length and offset of each share's arc on a circle."""
    round_ = 2 * math.pi * radius
    before = running_before(segments, group, "pct", *order)
    return segments.select("*", (F.col("pct") / 100 * round_).alias("length"), (-before / 100 * round_).alias("offset"))


def laid_out(segments: DataFrame, group: str, rank: Column) -> DataFrame:
    """Shares above 0 by rank, then size, with the sum before each."""
    rows = segments.where("pct > 0").withColumn("rank", rank)
    return rows.withColumn("before", running_before(rows, group, "pct", "rank", F.desc("pct")))
