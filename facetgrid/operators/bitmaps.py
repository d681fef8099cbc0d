"""Bitmaps of positions: inverted facet index, its wire form, and set operations.

Rows stay relational as long as they can; bitmaps serve the wire form and exact
set counts.  A bitmap of more than ``BUCKET`` positions is a row for each bucket
of positions, so no row grows with the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET = 32768  # positions in one bitmap of Spark's


def bitmap_rows(df: DataFrame, value: str, position: str) -> DataFrame:
    """(value, bucket, bits): positions from 0, one row for each value and bucket."""
    at = F.col(position) + 1
    return df.groupBy(F.col(value).alias("value"), F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """(bucket, bits) of both, bucket by bucket; buckets of one side only are empty."""
    both = a.select("bucket", "bits").unionByName(b.select("bucket", "bits")).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("sides"))
    return both.where("sides = 2").select("bucket", "bits")


def count_bits(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("long").alias("n"))


def has(bits: Column, position: Column) -> Column:
    """Whether the position is set; beyond the end it is not."""
    byte = F.coalesce(F.conv(F.hex(F.substring(bits, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int"), F.lit(0))
    return (position >= 0) & (F.pmod(F.floor(byte / F.pow(F.lit(2), position % 8)), F.lit(2)) == 1)


def positions(bits: Column) -> Column:
    """array<int> of the set positions, ascending: the bits are read as bytes once, and only bytes that are not zero are looked into."""
    each = F.transform(F.regexp_extract_all(F.hex(bits), F.lit("[0-9A-F]{2}"), F.lit(0)), lambda x, k: F.struct(x.alias("x"), k.alias("k")))
    some = F.filter(each, lambda b: b["x"] != "00")
    of_byte = F.array(*[F.array(*[F.lit(j) for j in range(8) if v >> j & 1]).cast("array<int>") for v in range(256)])
    value = lambda x: F.instr(F.lit("0123456789ABCDEF"), F.substring(x, 1, 1)) * 16 + F.instr(F.lit("0123456789ABCDEF"), F.substring(x, 2, 1)) - 17
    return F.flatten(F.transform(some, lambda b: F.transform(F.get(of_byte, value(b["x"])), lambda j: b["k"] * 8 + j)))


def explode_positions(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep..., position) of bitmap rows."""
    each = rows.select(*keep, "bucket", F.explode(positions(F.col("bits"))).alias("_at"))
    return each.select(*keep, ((F.col("bucket") - 1) * BUCKET + F.col("_at")).alias("position"))


def to_base64(bits: Column, n: int) -> Column:
    """Wire form of ``n`` positions (one bucket): whole 64-bit words, no line breaks."""
    width = 8 * -(-n // 64)
    padded = F.substring(F.concat(bits, F.unhex(F.repeat(F.lit("00"), width))), 1, width)
    return F.regexp_replace(F.base64(padded), "[\r\n]", "")


def from_base64(text: Column) -> Column:
    """Bits of the wire form, a short last word filled with zeros; null if it is no base64."""
    bits = F.try_to_binary(text, F.lit("base64"))
    return F.concat(bits, F.unhex(F.repeat(F.lit("00"), F.pmod(-F.octet_length(bits), F.lit(8)))))


def wire_buckets(df: DataFrame, value: str, position: str) -> DataFrame:
    """(value, bucket, wire): the wire form of each bucket of positions, whatever their number."""
    return bitmap_rows(df, value, position).select("value", "bucket", to_base64(F.col("bits"), BUCKET).alias("wire"))


def inverted_index(df: DataFrame, value: str, position: str, n: int) -> DataFrame:
    """(value, wire) for catalogues of one bucket, as the dataset document carries it."""
    if n > BUCKET:
        raise ValueError(f"the wire form holds {BUCKET} rows at most; keep bitmap_rows beyond")
    return bitmap_rows(df, value, position).select("value", to_base64(F.col("bits"), n).alias("wire"))
