"""Logical inputs built from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.session import spread

AS_OF = "2024-01-31"
NOW = "2024-02-01 09:00:00"
SCORE_KEYS = ["points", "score", "upvotes", "likes", "num_comments"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    """A table of long texts, whose rows cost more to work on than to move."""
    return spread(table(spark, sf, name), key)


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def posts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as posts; the metadata key rotates with the event id."""
    e = table(spark, sf, "events")
    value = F.round("value").cast("bigint").cast("string")
    key = F.element_at(F.array(*[F.lit(k) for k in SCORE_KEYS]), (F.col("event_id") % 6 + 1).cast("int"))
    metadata = F.when(F.col("event_id") % 6 == 5, F.lit("{}")).otherwise(
        F.concat(F.lit('{"'), key, F.lit('": '), value, F.lit("}"))
    )
    return e.select(
        F.col("event_type").alias("source"), F.col("event_id").cast("string").alias("source_id"),
        F.lit(None).cast("string").alias("source_url"), F.col("user_id").cast("string").alias("author"),
        F.col("props").alias("content"), F.col("ts").alias("timestamp"), F.lit(None).cast("string").alias("parent_id"),
        metadata.alias("metadata"), F.col("ts").alias("fetched_at"), F.col("event_id").alias("post_id"),
    )


def text_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as posts with text."""
    d = texts(spark, sf, "documents", "doc_id")
    return d.select(
        F.col("doc_id").alias("post_id"), "source", F.col("doc_id").cast("string").alias("source_id"),
        F.lit(None).cast("string").alias("source_url"), F.col("lang").alias("author"), F.col("text").alias("content"),
        (ntz("2024-01-01") + F.make_dt_interval(mins=(F.col("doc_id") % 500_000 * 7).cast("int"))).alias("timestamp"),
    )


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as chat messages."""
    c = texts(spark, sf, "conversations", "conv_id")
    return c.select(
        F.col("conv_id").cast("string").alias("channel"), F.col("turn").alias("ordinal"), F.col("role").alias("author"),
        F.col("text").alias("content"), F.concat(F.lit("["), "role", F.lit("]\n"), "text", F.lit("\n")).alias("block"),
        (ntz("2026-04-17") + F.make_dt_interval(mins=((F.col("conv_id") * 60 + F.col("turn")) % 500_000).cast("int"))).alias("ts_kst"),
    )


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as articles, tagged from the labels."""
    d, lab = texts(spark, sf, "documents", "doc_id"), table(spark, sf, "labels")
    created = ntz("2024-01-01") + F.make_dt_interval(mins=(F.col("doc_id") % 500_000 * 7).cast("int"))
    slot = F.col("doc_id") % 7
    return d.join(lab, "doc_id", "left").select(
        F.concat(F.lit("art-"), F.col("doc_id").cast("string")).alias("id"), F.col("doc_id").alias("ord"),
        F.substring_index("text", "\n", 1).alias("headline"), F.col("text").alias("body"),
        F.when(F.col("toxic") == 0, "news").otherwise("rumor").alias("category"),
        F.when(F.col("quality") == 1, "high").otherwise("low").alias("trust"),
        created.alias("created_at"),
        F.when(slot == 0, "top").when(slot <= 2, "main").when(slot <= 5, "side").alias("placement"),
        created.alias("placed_at"), F.col("source").alias("origin"), F.col("lang"),
    )


def is_new():
    return F.col("ord") % 5 == 0


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as ingest runs."""
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "P", "error").otherwise("running")
    return o.select(
        F.col("o_orderpriority").alias("source"), F.col("o_orderdate").alias("started_at"), status.alias("status"),
        F.col("o_orderkey").alias("run_no"), F.col("o_custkey").alias("rows_read"),
    )


def publish_log(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents as published articles on two platforms."""
    lab = table(spark, sf, "labels")
    return lab.select(
        F.concat(F.lit("art-"), F.col("doc_id").cast("string")).alias("article_id"),
        F.when(F.col("quality") == 1, "github_pages").otherwise("discord").alias("platform"),
    )
