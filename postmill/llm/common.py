"""What the operators share: reading tables, written intermediate results, ranks in slices."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.session import RELEASE, new_folder, ship, written


def once(key: tuple, make: Callable):
    """``make()``, made once in a Python process and kept for later tasks of a reused worker.

    Functions travel by value, so what they keep in their own module would be gone with the task.
    """
    held = vars(sys).setdefault("_postmill_once", {})
    if key not in held:
        held[key] = make()
    return held[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SLICE_ROWS = 50_000


def ranks_in_groups(df: DataFrame, group: str, counts: dict[int, int], order: list[Column], rank_col: str = "__rank") -> DataFrame:
    """Add the gapless rank, from 0, of each row within ``group``, by slice and then ``order``.

    ``counts`` are the rows of each group; their number is bounded by the caller. A group is ranked in
    slices of about ``SLICE_ROWS`` rows each, so none needs a task that grows with it; slices follow the
    hash of ``order``.
    """
    spark = df.sparkSession
    kind = dict(df.dtypes)[group]
    slices = spark.createDataFrame([(g, max(1, -(-n // SLICE_ROWS))) for g, n in counts.items()], f"{group} {kind}, __slices bigint")
    sliced = df.join(F.broadcast(slices), group).withColumn("__slice", F.pmod(F.xxhash64(*order), F.col("__slices")))
    heads = sliced.groupBy(group, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(group).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    heads = heads.select(group, "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = W.partitionBy(group, "__slice").orderBy(*order)
    ranked = sliced.withColumn(rank_col, F.row_number().over(inside) - 1)
    return ranked.join(heads, [group, "__slice"]).withColumn(rank_col, F.col(rank_col) + F.col("__before")).drop(
        "__slices", "__slice", "__before"
    )


def place_in_spans(ranked: DataFrame, group: str, spans: DataFrame) -> DataFrame:
    """Join each rank with the span ``[__low, __high)`` of its group; spans are as bounded as the groups."""
    s = F.broadcast(spans)
    inner = (ranked[group] == s[group]) & (ranked["__rank"] >= s["__low"]) & (ranked["__rank"] < s["__high"])
    return ranked.join(s, inner).drop(s[group])


def bound_batches(spark: SparkSession) -> None:
    """Keep batches for Python small in rows and bytes, whatever the length of texts."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "16m")):
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)


__all__ = ["RELEASE", "bound_batches", "new_folder", "once", "place_in_spans", "ranks_in_groups", "ship", "table", "written"]

ship(__name__)
