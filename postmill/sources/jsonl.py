"""Crawl files: posts as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill import schemas
from postmill.functions.text import strip
from postmill.functions.times import kst_date


def read_posts_jsonl(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines) of JSON-lines files; blank lines are neither.

    Fields stay text: an unreadable timestamp is a matter of validation, not of parsing.
    """
    return parse_post_lines(spark.read.text(path))


def parse_post_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines) of lines in ``value``."""
    parsed = F.from_json("value", schemas.RAW_POSTS, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.where(strip("value") != "").select("value", parsed.alias("p")).select("value", "p.*")
    good = F.col("_corrupt").isNull()
    return rows.where(good).drop("_corrupt", "value"), rows.where(~good).select("value")


def typed_posts(raw: DataFrame) -> DataFrame:
    """Raw rows with real timestamps; an unreadable one becomes null, which validation rejects."""
    return raw.withColumns({
        "timestamp": F.try_to_timestamp("timestamp"), "fetched_at": F.try_to_timestamp("fetched_at"),
    })


def write_posts(posts: DataFrame, path: str, mode: str = "append", max_rows: int = 1_000_000) -> None:
    """One file set per source and KST date; a large one is split into files of ``max_rows``."""
    dated = posts.withColumn("dt", kst_date("timestamp")).hint("rebalance", "source", "dt")
    dated.write.option("maxRecordsPerFile", max_rows).partitionBy("source", "dt").mode(mode).json(path)
