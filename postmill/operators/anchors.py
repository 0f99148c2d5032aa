"""Which earlier article a merged article continues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.operators.lookups import merge_lineage
from postmill.session import cut_lineage


def assign_anchors(wishes: DataFrame) -> DataFrame:
    """Give each final its best id not taken by an earlier final.

    ``wishes`` are (run_id, final_no, id, wish). Finals choosing in order is the one stable
    matching when every id prefers the earlier final: all finals ask for their best id that
    has not refused them, an id refuses all but the earliest asker, until nobody is refused.
    """
    open_wishes = cut_lineage(wishes.select("run_id", "final_no", "id", "wish"))
    count = open_wishes.count()
    # Every round but the last takes at least one wish away.
    while True:
        asks = open_wishes.groupBy("run_id", "final_no").agg(F.min(F.struct("wish", "id")).alias("w"))
        asks = asks.select("run_id", "final_no", "w.id", "w.wish")
        holders = asks.groupBy("run_id", "id").agg(F.min("final_no").alias("holder"))
        # Later finals can drop an id as soon as someone earlier holds it: holders only get earlier.
        left = open_wishes.join(holders, ["run_id", "id"], "left").where(
            F.col("holder").isNull() | (F.col("final_no") <= F.col("holder"))
        )
        left = cut_lineage(left.select("run_id", "final_no", "id", "wish"))
        remaining = left.count()
        if remaining == count:
            return asks.select("run_id", "final_no", "id")
        open_wishes, count = left, remaining


def merge_anchor(finals: DataFrame, candidates: DataFrame, preserve: DataFrame, now: Column) -> DataFrame:
    """Turn merged finals into articles.

    ``finals`` are (run_id, final_no, headline, body, merged_from). A final takes the oldest
    preserved id among its sources that no earlier final took, with that article's dates and
    placement; otherwise it is a new article dated by its newest source.
    """
    keys = ["run_id", "final_no"]
    sources = finals.select(*keys, F.posexplode("merged_from").alias("pos", "id"))
    dated = sources.join(preserve.select("id").distinct(), "id", "left_semi").join(
        candidates.select("id", F.coalesce("created_at", now).alias("created_at")), "id"
    )
    wishes = dated.select(*keys, "id", F.struct("created_at", "pos").alias("wish"))
    anchors = assign_anchors(wishes).join(
        candidates.select(
            "id", F.coalesce("created_at", now).alias("a_created"), F.col("placement").alias("a_placement"),
            F.coalesce("placed_at", now).alias("a_placed"),
        ), "id",
    ).withColumnRenamed("id", "anchor")
    tagged = finals.withColumn("final_id", F.struct(*keys))
    newest = merge_lineage(tagged, candidates).select("final_id.*", F.col("created_at").alias("newest"))
    number = F.col("final_no").cast("string")
    fresh_id = F.concat(
        F.lit("art-"), F.date_format(now, "yyyyMMddHHmm"), F.lit("-m"),
        F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number),
    )
    joined = finals.join(anchors, keys, "left").join(newest, keys, "left")
    kept = F.col("anchor").isNotNull()
    return joined.select(
        *keys,
        F.coalesce("anchor", fresh_id).alias("id"), "headline", "body",
        F.when(kept, F.col("a_created")).otherwise(F.coalesce("newest", now)).alias("created_at"),
        F.when(kept, F.col("a_placement")).alias("placement"),
        F.when(kept, F.col("a_placed")).otherwise(now).alias("placed_at"),
        "merged_from",
    )
