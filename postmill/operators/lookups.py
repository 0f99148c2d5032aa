"""Keyed lookups between articles, replies and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.replies import clean_id, unpad


def restore_missing(cache: DataFrame, current: DataFrame, as_of: Column) -> DataFrame:
    """Cached rows whose headline is gone, with missing times set to ``as_of``."""
    lost = cache.join(current.select("headline").distinct(), "headline", "left_anti").select(cache.columns)
    return lost.withColumns({
        "placed_at": F.coalesce("placed_at", as_of), "created_at": F.coalesce("created_at", as_of),
    })


def unpublished(articles: DataFrame, log: DataFrame, platform: str) -> DataFrame:
    done = log.where(F.col("platform") == platform).select(F.col("article_id").alias("id"))
    return articles.join(done, "id", "left_anti")


def apply_drops(articles: DataFrame, drops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept rows, dropped ids in order)."""
    dropped = articles.join(drops.select("id"), "id", "left_semi").select("id")
    return articles.join(drops.select("id"), "id", "left_anti"), dropped.orderBy("id")


def apply_placements(articles: DataFrame, placements: DataFrame, as_of: Column) -> DataFrame:
    """Set placements; ``placed_at`` moves only when an existing placement changes."""
    given = placements.select("id", F.col("placement").alias("__new"))
    joined = articles.join(given, "id", "left").withColumn("__new", F.coalesce("__new", F.lit("side")))
    moved = F.col("placement").isNotNull() & (F.col("placement") != F.col("__new"))
    return joined.withColumns({
        "placed_at": F.when(moved, as_of).otherwise(F.col("placed_at")), "placement": F.col("__new"),
    }).drop("__new")


def apply_tags(articles: DataFrame, tags: DataFrame) -> DataFrame:
    """Set category and trust; untagged articles are low-trust rumours."""
    given = tags.select("id", F.col("category").alias("__c"), F.col("trust").alias("__t"))
    joined = articles.drop("category", "trust").join(given, "id", "left")
    return joined.withColumns({
        "category": F.coalesce("__c", F.lit("rumor")), "trust": F.coalesce("__t", F.lit("low")),
    }).drop("__c", "__t")


def short_id(c: Column | str) -> Column:
    return F.substring_index(c, "-", -1)


def resolve_short_ids(refs: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolve (reply_id, pos, ref) to full ids: (resolved, ambiguous).

    A ref may be the last id segment, with or without leading zeros, or the full id. The
    lookup is reduced to one row per key first, so a segment shared by very many articles
    costs one row; such a ref is reported as ambiguous instead of picking one of them.
    """
    ids = articles.select("id").withColumn("short", short_id("id"))
    keys = ids.select(
        "id",
        F.explode(F.array(
            F.struct(F.col("short").alias("key"), F.lit(1).alias("kind")),
            F.struct(unpad(F.col("short")).alias("key"), F.lit(1).alias("kind")),
            F.struct(F.col("id").alias("key"), F.lit(2).alias("kind")),
        )).alias("k"),
    )
    lookup = keys.groupBy(F.col("k.key").alias("key"), F.col("k.kind").alias("kind")).agg(
        F.min("id").alias("id"), (F.min("id") != F.max("id")).alias("ambiguous")
    )
    asked = refs.withColumn("ref", clean_id(F.col("ref"))).where("ref <> ''")
    tries = asked.select(
        "reply_id", "pos", "ref",
        F.explode(F.array(
            F.struct(F.lit(0).alias("prio"), F.col("ref").alias("key"), F.lit(1).alias("kind")),
            F.struct(F.lit(1).alias("prio"), unpad(F.col("ref")).alias("key"), F.lit(1).alias("kind")),
            F.struct(F.lit(2).alias("prio"), F.col("ref").alias("key"), F.lit(2).alias("kind")),
        )).alias("t"),
    ).select("reply_id", "pos", "ref", "t.*")
    found = (
        tries.join(lookup, ["key", "kind"])
        .groupBy("reply_id", "pos", "ref")
        .agg(F.min(F.struct("prio", "ambiguous", "id")).alias("hit"))
        .select("reply_id", "pos", "ref", "hit.ambiguous", "hit.id")
    )
    resolved = found.where("NOT ambiguous").groupBy("reply_id", "id").agg(F.min("pos").alias("pos"))
    return resolved.select("reply_id", "pos", "id"), found.where("ambiguous").select("reply_id", "pos", "ref")


def merge_lineage(finals: DataFrame, candidates: DataFrame) -> DataFrame:
    """Newest source date and number of known sources per final (final_id, merged_from)."""
    links = finals.select("final_id", F.explode("merged_from").alias("id"))
    dated = links.join(candidates.select("id", "created_at"), "id")
    grouped = dated.groupBy("final_id").agg(F.max("created_at").alias("created_at"), F.count(F.lit(1)).alias("n_sources"))
    return finals.select("final_id").join(grouped, "final_id", "left").select(
        "final_id", "created_at", F.coalesce("n_sources", F.lit(0)).alias("n_sources")
    )


def coverage_gap(candidates: DataFrame, mentioned: DataFrame, discards: DataFrame) -> DataFrame:
    """Candidates neither merged nor discarded."""
    left = candidates.join(mentioned.select("id"), "id", "left_anti")
    return left.join(discards.select("id"), "id", "left_anti")


def split_existing_new(rows: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = existing.select("id")
    return rows.join(ids, "id", "left_semi"), rows.join(ids, "id", "left_anti")
