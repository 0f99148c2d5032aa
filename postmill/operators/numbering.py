"""Running totals and dense numbers over long sequences, without one task per sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 50_000


def with_offsets(
    df: DataFrame, keys: list[str], ordinal: str, sums: dict[str, Column], block: int = BLOCK
) -> DataFrame:
    """Add exclusive running sums of ``sums`` in ``ordinal`` order within ``keys``.

    ``ordinal`` is a non-negative integer, unique within its keys. Rows are summed in
    blocks of at most ``block`` ordinals; only the block totals, one row per block, are
    carried along a whole sequence. Also adds ``__blk``.
    """
    df = df.withColumn("__blk", F.floor(F.col(ordinal) / F.lit(block)).cast("bigint"))
    cols = df.columns
    for name, value in sums.items():
        df = df.withColumn(f"__v_{name}", value.cast("bigint"))
    totals = df.groupBy(*keys, "__blk").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    before = W.partitionBy(*keys).orderBy("__blk").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(
        *keys, "__blk",
        *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums],
    )
    inside = W.partitionBy(*keys, "__blk").orderBy(ordinal).rowsBetween(W.unboundedPreceding, -1)
    local = df.select(
        *cols, *[F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0)).alias(f"__l_{n}") for n in sums]
    )
    joined = local.join(totals, [*keys, "__blk"])
    return joined.select(*cols, *[(F.col(f"__o_{n}") + F.col(f"__l_{n}")).alias(n) for n in sums])


def assign_ids(articles: DataFrame, run_at: Column, chunk: str = "chunk_index", pos: str = "pos") -> DataFrame:
    """Batch ids ``art-YYYYMMDDHHMM-NN`` in (run, chunk, position) order; ``run_at`` is KST wall time.

    Rows are counted per chunk of a run; only these counts, one row per reply, are carried along a run.
    """
    placed = articles.withColumn("__run", F.date_format(run_at, "yyyyMMddHHmm"))
    counts = placed.groupBy("__run", chunk).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy("__run").orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("__run", chunk, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy("__run", chunk).orderBy(pos))
    seq = F.col("__before") + F.col("__in")
    numbered = placed.withColumn("__in", inside).join(counts, ["__run", chunk]).withColumn("seq", seq)
    number = F.col("seq").cast("string")
    padded = F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)
    return numbered.withColumn("id", F.concat(F.lit("art-"), F.col("__run"), F.lit("-"), padded)).drop("__run", "__before", "__in")
