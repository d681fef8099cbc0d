"""Sharding by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a prime-sized table (offset
and skip from a digest of its name) and the shards take turns claiming their
next free slot.  The table gives each shard nearly the same number of slots, and
when a shard leaves or joins few other slots change hands.  A row's slot is its
key's hash modulo the table size; the table is broadcast (its size is the
parameter ``slots``, whatever the input), so placing a row is one lookup.

Nulls and odd input: a null key hashes to a fixed value and so has a place like
any other; equal keys share a shard; an empty table gives an empty result;
columns called slot or shard are replaced.  A hot key is a matter of the key
chosen: by default rows are placed by doc_id, so a hot source is spread evenly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = SLOTS, weights: Sequence[int] | None = None) -> list[int]:
    """Slot -> index of the shard that claimed it.

    ``weights``: slots a shard claims in each turn (1 each if not given).
    """
    if not is_prime(slots) or not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct and at most as many as the slots, whose number must be prime")
    turns = list(weights or [1] * len(shards))
    if len(turns) != len(shards) or min(turns) < 1:
        raise ValueError("one positive weight for each shard")
    at, skip = [], []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        at.append(int.from_bytes(digest[:8], "big") % slots)
        skip.append(int.from_bytes(digest[8:16], "big") % (slots - 1) + 1)
    owner = [-1] * slots
    left = slots
    while True:
        for k, claims in enumerate(turns):
            for _ in range(claims):
                while owner[at[k]] >= 0:
                    at[k] = (at[k] + skip[k]) % slots
                owner[at[k]] = k
                left -= 1
                if not left:
                    return owner


def table_frame(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS, weights: Sequence[int] | None = None) -> DataFrame:
    owner = lookup_table(shards, slots, weights)
    return spark.createDataFrame([(k, shards[o]) for k, o in enumerate(owner)], "slot int, shard string")


def place(df: DataFrame, shards: Sequence[str], key: Column | None = None, slots: int = SLOTS, weights: Sequence[int] | None = None) -> DataFrame:
    """``df`` with slot and shard."""
    key = F.col("doc_id") if key is None else key
    rows = df.drop("slot", "shard").withColumn("slot", F.pmod(F.xxhash64(key), F.lit(slots)).cast("int"))
    return rows.join(F.broadcast(table_frame(df.sparkSession, shards, slots, weights)), "slot")


def write_shards(df: DataFrame, path: str, shards: Sequence[str], key: Column | None = None, files_each: int = 1) -> None:
    """Write one folder for each shard; ``files_each`` tasks write each folder."""
    placed = place(df, shards, key)
    salt = F.pmod(F.xxhash64("slot"), F.lit(files_each))
    placed.repartition(len(shards) * files_each, "shard", salt).drop("slot").write.partitionBy("shard").parquet(path)
