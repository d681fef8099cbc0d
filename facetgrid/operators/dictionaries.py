"""Dictionaries: distinct labels in a domain order, and encoding by broadcast joins.

A dictionary is small by nature (labels of a facet).  Its positions come from a
window over its distinct labels, not over the rows, and ``encode`` broadcasts it
only below ``MAX_BROADCAST`` labels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetgrid.functions.text import OTHER

MAX_BROADCAST = 100_000
# Orders of known labels.
TERMS = ("1学期", "1学期前半", "1学期後半", "2学期", "2学期前半", "2学期後半", "通年", "前期", "後期")
CAMPUSES = ("朝倉キャンパス", "物部キャンパス", "岡豊キャンパス", OTHER)
UNKNOWN = 99


def known_order(label: Column, known: Sequence[str]) -> Column:
    """Position among the known labels; all unknown ones after them."""
    table = F.create_map(*[F.lit(x) for k, name in enumerate(known) for x in (name, k)])
    return F.coalesce(F.try_element_at(table, label), F.lit(UNKNOWN))


def other_last(label: Column) -> Column:
    return (label == OTHER).cast("int")


def dictionary(labels: DataFrame, order: Column) -> DataFrame:
    """(idx, label) of the one-column frame's distinct labels, by ``order`` (of "label"), then bytes."""
    distinct = labels.toDF("label").where("label is not null").distinct()
    return distinct.select((F.row_number().over(W.orderBy(order, "label")) - 1).alias("idx"), "label")


def terms(labels: DataFrame) -> DataFrame:
    return dictionary(labels, known_order(F.col("label"), TERMS))


def campuses(labels: DataFrame) -> DataFrame:
    return dictionary(labels, known_order(F.col("label"), CAMPUSES))


def catch_all_last(labels: DataFrame) -> DataFrame:
    return dictionary(labels, other_last(F.col("label")))


def small_side(df: DataFrame, most: int = MAX_BROADCAST) -> DataFrame:
    """``df`` marked for a broadcast if it has at most ``most`` rows; else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def encode(df: DataFrame, column: str, entries: DataFrame, into: str, default: int | None = 0) -> DataFrame:
    """``df`` with the position of ``column`` in the dictionary; ``default`` (or no row, if None) for unknown labels."""
    side = small_side(entries.select(F.col("label").alias(f"_{into}"), F.col("idx").alias(into)))
    joined = df.join(side, F.col(column) == F.col(f"_{into}"), "inner" if default is None else "left").drop(f"_{into}")
    return joined if default is None else joined.withColumn(into, F.coalesce(into, F.lit(default)))
