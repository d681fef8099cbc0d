"""Bitmaps of any number of positions: containers by bucket, and the wire form of all buckets.

A container holds the positions of one value in one bucket of ``BUCKET``
positions, in the smallest of three forms: the positions themselves, runs of
them, or bits.  Rows (value, bucket) never grow with the input.  Containers are
merged by reading them back and aggregating again, which combines before its
shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetgrid.functions.text import let
from facetgrid.operators.bitmaps import BUCKET, bitmap_rows, positions

#: Kinds of containers; numbers are two bytes each, the higher one first.
ARRAY, RUNS, BITS = "array", "runs", "bits"


def _bytes(numbers: Column) -> Column:
    return F.unhex(F.array_join(F.transform(numbers, lambda p: F.lpad(F.hex(p), 4, "0")), ""))


def _numbers(data: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.hex(data), F.lit("[0-9A-F]{4}"), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("int"))


def _runs(at: Column) -> Column:
    """First and last positions of the runs in turn, of ascending positions."""
    heads = F.filter(at, lambda p, k: (k == 0) | (F.get(at, k - 1) != p - 1))
    tails = F.filter(at, lambda p, k: F.coalesce(F.get(at, k + 1) != p + 1, F.lit(True)))
    return F.flatten(F.zip_with(heads, tails, lambda a, b: F.array(a, b)))


def pack(rows: DataFrame) -> DataFrame:
    """(value, bucket, n, kind, data) of bitmap rows (value, bucket, bits)."""
    at = rows.withColumn("_at", positions(F.col("bits"))).where(F.size("_at") > 0).withColumn("_runs", _runs(F.col("_at")))
    whole = F.octet_length("bits")
    kind = F.when((2 * F.size("_runs") <= 2 * F.size("_at")) & (2 * F.size("_runs") < whole), RUNS).when(2 * F.size("_at") < whole, ARRAY).otherwise(BITS)
    made = at.withColumn("kind", kind)
    data = F.when(F.col("kind") == RUNS, _bytes(F.col("_runs"))).when(F.col("kind") == ARRAY, _bytes(F.col("_at"))).otherwise(F.col("bits"))
    return made.select("value", "bucket", F.size("_at").alias("n"), "kind", data.alias("data"))


def members(kind: Column, data: Column) -> Column:
    """array<int> of a container's positions in its bucket, ascending."""
    spans = let(_numbers(data), lambda r: F.flatten(F.transform(F.sequence(F.lit(0), (F.size(r) / 2).cast("int") - 1), lambda k: F.sequence(F.get(r, 2 * k), F.get(r, 2 * k + 1)))))
    return F.when(kind == RUNS, spans).when(kind == ARRAY, _numbers(data)).otherwise(positions(data))


def unpack(containers: DataFrame, *keep: str) -> DataFrame:
    """(keep..., position) of containers."""
    each = containers.select(*keep, "bucket", F.explode(members(F.col("kind"), F.col("data"))).alias("_at"))
    return each.select(*keep, ((F.col("bucket") - 1) * BUCKET + F.col("_at")).alias("position"))


def build(df: DataFrame, value: str, position: str) -> DataFrame:
    """Containers of the positions of each value."""
    return pack(bitmap_rows(df, value, position))


def merge(*parts: DataFrame) -> DataFrame:
    """The union of containers, as containers."""
    rows = reduce(DataFrame.unionByName, [unpack(p, "value") for p in parts])
    return build(rows, "value", "position")


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """(value, position) in both, value by value."""
    sides = unpack(a, "value").withColumn("side", F.lit(1)).unionByName(unpack(b, "value").withColumn("side", F.lit(2)))
    both = sides.groupBy("value", "position").agg(F.count_distinct("side").alias("n"))
    return both.where("n = 2").select("value", "position")


def wire(rows: DataFrame, n: int | Column, *by: str) -> DataFrame:
    """(by..., wire): base64 of ``n`` positions as whole 64-bit words, the lower bytes first, from bitmap rows (by..., bucket, bits).

    One value's bits are one string, ``n / 6`` characters long.
    """
    n = F.lit(n) if isinstance(n, int) else n
    listed = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("bucket", F.rpad(F.hex("bits"), BUCKET // 4, "0").alias("hex")))).alias("l"))
    # Buckets that a value has nothing in are zeros.
    gap = lambda x, k: F.repeat(F.lit("0"), ((x["bucket"] - F.coalesce(F.get(F.col("l"), k - 1)["bucket"], F.lit(0)) - 1) * (BUCKET // 4)).cast("int"))
    joined = F.array_join(F.transform("l", lambda x, k: F.concat(gap(x, k), x["hex"])), "")
    width = (16 * F.ceil(n / 64)).cast("int")
    return listed.select(*by, F.regexp_replace(F.base64(F.unhex(F.rpad(joined, width, "0"))), "[\r\n]", "").alias("wire"))


def from_wire(wires: DataFrame, *keep: str) -> DataFrame:
    """(keep..., position) of rows (keep..., wire), read in pieces of a bucket each."""
    bits = wires.select(*keep, F.hex(F.try_to_binary("wire", F.lit("base64"))).alias("hex"))
    last = F.ceil(F.length("hex") / (BUCKET // 4)).cast("int")
    each = bits.where("hex <> ''").select(*keep, "hex", F.explode(F.sequence(F.lit(1), last)).alias("bucket"))
    part = F.substring(F.col("hex"), ((F.col("bucket") - 1) * (BUCKET // 4) + 1), F.lit(BUCKET // 4))
    found = each.select(*keep, "bucket", F.explode(positions(F.unhex(part))).alias("_at"))
    return found.select(*keep, ((F.col("bucket") - 1) * BUCKET + F.col("_at")).cast("long").alias("position"))
