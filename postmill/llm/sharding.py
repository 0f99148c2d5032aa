"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import place_in_spans, ranks_in_groups

VNODES = 128
CELL_BITS = 12


@dataclass(frozen=True)
class Ring:
    """Sorted points of the virtual nodes and the shard of each; point i ends arc i."""

    points: list[int]
    owners: list[int]


def build_ring(spark: SparkSession, shards: int, vnodes: int = VNODES) -> Ring:
    """``shards * vnodes`` points; a further shard adds points and moves none."""
    rows = (
        spark.range(shards * vnodes)
        .select(F.floor(F.col("id") / vnodes).alias("shard"), F.xxhash64(F.concat_ws("#", F.lit("vnode"), "id")).alias("point"))
        .collect()
    )
    ordered = sorted((r.point, r.shard) for r in rows)
    return Ring([p for p, _ in ordered], [s for _, s in ordered])


def _cells(spark: SparkSession, ring: Ring) -> DataFrame:
    """Per cell of the ring its points and the arc that follows: ``2 ** CELL_BITS`` rows at most."""
    shift = 64 - CELL_BITS
    rows = []
    for cell in range(-(1 << CELL_BITS - 1), 1 << CELL_BITS - 1):
        lo = bisect_left(ring.points, cell << shift)
        hi = bisect_left(ring.points, (cell + 1) << shift)
        rows.append((cell, [(ring.points[i], i) for i in range(lo, hi)], hi % len(ring.points)))
    return spark.createDataFrame(rows, "__cell bigint, __in array<struct<point: bigint, arc: int>>, __after int")


def place_on_ring(df: DataFrame, ring: Ring, key: Column) -> DataFrame:
    """Add ``__pos``, the hash of ``key``, and ``__arc``, the first virtual node clockwise from it."""
    cells = F.broadcast(_cells(df.sparkSession, ring))
    placed = df.withColumn("__pos", F.xxhash64(key)).withColumn("__cell", F.shiftright("__pos", 64 - CELL_BITS))
    here = F.filter("__in", lambda p: p["point"] >= F.col("__pos"))
    return placed.join(cells, "__cell").withColumn("__arc", F.coalesce(F.get(here, F.lit(0))["arc"], F.col("__after"))).drop(
        "__cell", "__in", "__after"
    )


def capacities(total: int, shards: int, slack: float) -> list[int]:
    """Rows each shard may take: with no slack the counts differ by one at most."""
    if slack <= 0:
        return [total // shards + (s < total % shards) for s in range(shards)]
    return [-int(-total * (1 + slack) // shards)] * shards


def spill_clockwise(ring: Ring, counts: dict[int, int], caps: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Split each arc's ranks among shards: ``(arc, low, high, shard, first slot)``.

    A shard takes its own arcs first; what overflows a full shard continues clockwise to the
    next virtual node of a shard with room. Pieces number at most twice the arcs and the shards.
    """
    n, used, pieces, left = len(ring.points), [0] * len(caps), [], {}

    def take(arc: int, low: int, count: int, shard: int) -> int:
        got = min(count, caps[shard] - used[shard])
        if got:
            pieces.append((arc, low, low + got, shard, used[shard]))
            used[shard] += got
        return got

    for arc in range(n):
        count = counts.get(arc, 0)
        got = take(arc, 0, count, ring.owners[arc])
        if got < count:
            left[arc] = (got, count - got)
    onward = list(range(1, n)) + [0]
    for arc, (low, count) in left.items():
        at = arc
        while count:
            path = []
            at = onward[at]
            while used[ring.owners[at]] >= caps[ring.owners[at]]:
                path.append(at)
                at = onward[at]
            for p in path:
                onward[p] = at
            got = take(arc, low, count, ring.owners[at])
            low, count = low + got, count - got
    return pieces


def shard_by_ring(
    df: DataFrame, key: Column, shards: int, vnodes: int = VNODES, slack: float = 0.0, tie: Column | None = None,
    shard_col: str = "shard", slot_col: str = "slot",
) -> DataFrame:
    """Every row of ``df`` with its shard and its gapless slot there.

    ``slack`` is the load bound: no shard takes more than ``(1 + slack)`` of the mean; 0 makes counts
    at most one apart. Rows of one arc are ranked by hash, key and ``tie``; which of equal rows comes
    first is open and shows in no value. Null keys share one place on the ring and overflow from it.
    An empty table gives an empty result; columns named as the two results are replaced. Only the
    counts per virtual node and the pieces of arcs, both bounded by ``shards * vnodes``, meet on the driver.
    """
    spark = df.sparkSession
    df = df.drop(shard_col, slot_col)
    ring = build_ring(spark, shards, vnodes)
    placed = place_on_ring(df, ring, key)
    counts = {r["__arc"]: r["n"] for r in placed.groupBy("__arc").agg(F.count(F.lit(1)).alias("n")).collect()}
    pieces = spill_clockwise(ring, counts, capacities(sum(counts.values()), shards, slack))
    spans = spark.createDataFrame(pieces, "__arc int, __low bigint, __high bigint, __shard int, __first bigint")
    order = [F.col("__pos"), key, *([tie] if tie is not None else [])]
    ranked = ranks_in_groups(placed, "__arc", counts, order)
    return place_in_spans(ranked, "__arc", spans).select(
        *[f"`{c}`" for c in df.columns], F.col("__shard").alias(shard_col),
        (F.col("__first") + F.col("__rank") - F.col("__low")).alias(slot_col),
    )
