"""Keyed merges and ordered unions.

The existing side of a merge is only anti-joined on its keys: it is neither sorted nor put
through a window, and stays in place when the incoming batch is small enough to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.operators.ranking import top_per_group

POST_KEYS = ["source", "source_id"]


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write wins: incoming rows by ``order``, then over existing rows."""
    latest = top_per_group(incoming, keys, [F.desc(c) for c in order], 1).select(existing.columns)
    return existing.join(latest.select(keys), keys, "left_anti").select(existing.columns).unionByName(latest)


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First write wins: existing rows, then incoming rows by ``order``."""
    first = top_per_group(incoming, keys, [F.asc(c) for c in order], 1).select(existing.columns)
    return existing.unionByName(first.join(existing.select(keys), keys, "left_anti").select(existing.columns))


def union_unique_by_id(a: DataFrame, b: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """Rows of ``a`` then of ``b``; the first row of every id stays."""
    both = a.withColumn("__side", F.lit(0)).unionByName(b.withColumn("__side", F.lit(1)))
    return top_per_group(both, [key], [F.asc("__side"), F.asc(order)], 1).drop("__side")


def collect_unique(rows: DataFrame) -> DataFrame:
    """One row per tweet, first page first; rows with neither id nor url all stay."""
    key = F.coalesce("id", "url")
    keyed = rows.where(key.isNotNull()).withColumn("__key", key)
    first = top_per_group(keyed, ["__key"], [F.asc("page_no"), F.asc("pos")], 1).drop("__key")
    return first.unionByName(rows.where(key.isNull()))


def concat_base_tail(base: DataFrame, tail: DataFrame, order: str = "ordinal") -> DataFrame:
    """Base export followed by the later tail; (part, order) is the reading order."""
    return base.withColumn("part", F.lit(0)).unionByName(tail.withColumn("part", F.lit(1))).orderBy("part", order)


def referential_cleanup(log: DataFrame, articles: DataFrame) -> DataFrame:
    """Log rows whose article still exists."""
    return log.join(articles.select(F.col("id").alias("article_id")), "article_id", "left_semi")


def save_public_state(
    pipeline_state: DataFrame, stored_articles: DataFrame, state: DataFrame, article_rows: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """New versions of (pipeline_state, articles) after saving one state document.

    ``state`` holds the row (key, value, updated_at); ``article_rows`` its articles in stored form.
    """
    return (
        upsert(pipeline_state, state, ["key"], ["updated_at"]),
        upsert(stored_articles, article_rows, ["id"], ["generated_at", "raw_json"]),
    )
