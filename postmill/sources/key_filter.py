"""Bloom filters of the keys of each stored source and day, probed before a day is opened.

A filter is made by an aggregate when the day is written. Days of more keys have more blocks of 4 KiB, a power
of two (the level); a key sets and tests all its bits in one block, so a probe is an equi-join of keys with blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 32_768
KEYS_PER_BLOCK = 1_000
BITS = 12  # with 1,000 keys in 32,768 bits a new key passes once in 1.4 million probes


def _hash(keys: list[str], seed: int) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys], F.lit(seed))


def _bit(i: int) -> Column:
    """The ``i``-th bit of a key in its block, from two hashes."""
    return F.pmod(F.col("h1") + F.lit(i) * F.col("h2"), F.lit(BLOCK_BITS))


def _hashed(rows: DataFrame, keys: list[str], *more: str) -> DataFrame:
    # Small enough numbers that no product overflows; the second is odd, so all bits differ.
    h1, h2 = F.pmod(_hash(keys, 1), F.lit(1 << 40)), F.pmod(_hash(keys, 2), F.lit(1 << 40)) * 2 + 1
    return rows.select(*more, _hash(keys, 0).alias("h0"), h1.alias("h1"), h2.alias("h2"))


def key_filters(rows: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """``parts, level, block, bits`` for the stored ``rows``; only their key columns are read."""
    sizes = rows.groupBy(*parts).agg(F.count(F.lit(1)).alias("n"))
    level = F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n") / KEYS_PER_BLOCK))).cast("int")
    named = _hashed(rows, keys, *parts).join(sizes.select(*parts, level.alias("level")), parts)
    placed = named.withColumn("block", F.pmod("h0", _blocks(F.col("level"))))
    set_bits = placed.select(*parts, "level", "block", F.explode(F.array(*[_bit(i) for i in range(BITS)])).alias("bit"))
    return set_bits.groupBy(*parts, "level", "block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _blocks(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), level)


def _has(bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring("bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    return F.pmod(F.floor(byte / F.pow(F.lit(2.0), bit % 8)), F.lit(2)) == 1


def probable_places(filters: DataFrame, batch: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """``parts`` with the keys of ``batch`` that may be stored there; every stored place of a key is among them.

    ``filters`` are the live filters. If ``source`` is a key, only its own filters are probed.
    """
    shared = [p for p in parts if p in keys]
    levels = filters.select(*shared, "level").distinct()
    asked = _hashed(batch.select(*keys).distinct(), keys, *keys)
    leveled = asked.join(levels, shared) if shared else asked.crossJoin(F.broadcast(levels))
    leveled = leveled.withColumn("block", F.pmod("h0", _blocks(F.col("level"))))
    met = leveled.join(filters, [*shared, "level", "block"])
    return met.where(reduce(lambda a, b: a & b, [_has(_bit(i)) for i in range(BITS)])).select(*keys, *[p for p in parts if p not in shared])
