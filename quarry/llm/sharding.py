"""Sharding by a permutation-filled lookup table of prime size."""

from __future__ import annotations

import math

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, math.isqrt(n) + 1))


def fill(shards: list[str], slots: int) -> list[int]:
    """The shard of each slot. Shards take turns; each claims the next free slot of its own permutation.

    A shard's permutation is offset + k * skip modulo the prime number of slots, both from hashes of its name,
    so a shard that joins or leaves moves few slots of the others.
    """
    if not is_prime(slots) or slots < len(shards) or not shards or len(set(shards)) != len(shards):
        raise ValueError("slots must be a prime, at least as many as the shards, and shard names distinct")
    at = [xxhash.xxh64_intdigest(s.encode(), 1) % slots for s in shards]
    skip = [xxhash.xxh64_intdigest(s.encode(), 2) % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    table, left = [-1] * slots, slots
    while left:
        for s in range(len(shards)):
            while table[at[s]] >= 0:
                at[s] = (at[s] + skip[s]) % slots
            table[at[s]] = s
            left -= 1
            if not left:
                break
    return table


def free(name: str, columns: list[str]) -> str:
    """name, or name_2, name_3 and so on if the rows have such a column."""
    k, out = 2, name
    while out.lower() in {c.lower() for c in columns}:
        out, k = f"{name}_{k}", k + 1
    return out


def shard(rows: DataFrame, shards: list[str], *keys: str, slots: int = 65_537) -> DataFrame:
    """rows with slot and shard, by a hash of the keys; where rows have such columns, slot_2 and shard_2 and so on.

    The table has `slots` rows whatever the input's size and is broadcast. A null key is a value of its own;
    equal keys always meet in one shard; an empty table stays empty.
    """
    spark, slot, name = rows.sparkSession, free("slot", rows.columns), free("shard", rows.columns)
    table = spark.createDataFrame([(k, shards[s]) for k, s in enumerate(fill(shards, slots))], f"`{slot}` long, `{name}` string")
    placed = rows.withColumn(slot, F.pmod(F.xxhash64(*keys), F.lit(slots)))
    return placed.join(F.broadcast(table), slot).select(*placed.columns, name)


def write_shards(rows: DataFrame, path: str, shards: list[str], *keys: str, files: int = 4) -> None:
    """Writes one folder per shard; `files` tasks share a shard, so that a large one isn't one task's work."""
    placed = shard(rows, shards, *keys)
    slot, name = placed.columns[-2:]
    placed.repartition(len(shards) * files, name, F.pmod(F.xxhash64(slot), F.lit(files))).write.partitionBy(name).mode("overwrite").parquet(path)
