"""Placement by the permutation-filled table, against its definition, and shards on disk."""

from collections import Counter

import xxhash
from pyspark.sql import functions as F

from quarry.llm import sharding


def slow_fill(names, slots):
    """Every shard's whole permutation is written out; shards take turns claiming their first free slot."""
    ways = []
    for s in names:
        at, skip = xxhash.xxh64_intdigest(s.encode(), 1) % slots, xxhash.xxh64_intdigest(s.encode(), 2) % (slots - 1) + 1
        ways.append([(at + k * skip) % slots for k in range(slots)])
        assert sorted(ways[-1]) == list(range(slots))
    table = {}
    while len(table) < slots:
        for k, way in enumerate(ways):
            if len(table) < slots:
                table[next(x for x in way if x not in table)] = k
    return [table[k] for k in range(slots)]


def test_fill_brute_force():
    for names, slots in ((["a"], 2), (["a", "b", "c"], 3), ([f"s{k}" for k in range(7)], 101), ([f"shard-{k:03d}" for k in range(64)], 509)):
        assert sharding.fill(names, slots) == slow_fill(names, slots)


def test_placement_brute_force(spark):
    """Each row goes to the shard of its key's slot; columns of the same names stay."""
    rows = spark.range(500).select("id", F.lit("mine").alias("shard"), F.lit(None).cast("string").alias("Slot"))
    names = [f"s{k}" for k in range(5)]
    table = slow_fill(names, 101)
    out = sharding.shard(rows, names, "id", slots=101)
    assert out.columns == ["id", "shard", "Slot", "slot_2", "shard_2"]
    hashes = {r.id: r.h for r in rows.select("id", F.pmod(F.xxhash64("id"), F.lit(101)).alias("h")).collect()}
    assert {(r.id, r.shard, r.slot_2, r.shard_2) for r in out.collect()} == {(k, "mine", h, names[table[h]]) for k, h in hashes.items()}


def test_written_shards(spark, tmp_path):
    rows = spark.range(3000).withColumn("text", F.concat(F.lit("t"), "id")).unionByName(spark.createDataFrame([(None, None)], "id long, text string"))
    names = [f"s{k}" for k in range(4)]
    sharding.write_shards(rows, str(tmp_path / "out"), names, "id", files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    want = sharding.shard(rows, names, "id")
    assert Counter((r.id, r.text, r.shard) for r in back.collect()) == Counter((r.id, r.text, r.shard) for r in want.collect())
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {f"shard={n}" for n in names}
