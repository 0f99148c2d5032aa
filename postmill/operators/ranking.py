"""Per-group and global top-k, and the sort orders of the views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.functions.scores import engagement_score
from postmill.functions.text import preview
from postmill.functions.times import Moment, moment
from postmill.session import cut_lineage

# Up to this k Spark itself trims every group before the shuffle.
WINDOW_LIMIT = 1000


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None, salts: int = 64
) -> DataFrame:
    """The first ``k`` rows of every group; ``order`` must be total within a group.

    For small k the rank filter becomes a group limit on the map side, so a group holding
    a third of all rows sends at most k rows per task through the shuffle. Larger k are
    first trimmed within salted slices of each group.
    """
    name = rank or "__rank"
    if k >= WINDOW_LIMIT:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
        sliced = df.withColumn("__salt", salt)
        w = W.partitionBy(*keys, "__salt").orderBy(*order)
        df = sliced.withColumn("__slice_rank", F.row_number().over(w)).where(F.col("__slice_rank") <= k)
        df = df.drop("__salt", "__slice_rank")
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)


def recent_top_by_source(
    posts: DataFrame, as_of: Moment, days: int = 3, per_source: int = 15, variant: str = "sql"
) -> DataFrame:
    """Best scored recent posts per source; equal (score, timestamp) resolve by source_id."""
    cutoff = moment(as_of, posts, "timestamp") - F.make_dt_interval(F.lit(max(days, 0)))
    scored = posts.where(F.col("timestamp") >= cutoff).withColumn("score", engagement_score("metadata", variant))
    order = [F.desc("score"), F.desc("timestamp"), F.asc("source_id")]
    return top_per_group(scored, ["source"], order, max(per_source, 1)).orderBy("source", *order)


def latest_run_per_source(runs: DataFrame, ties: list[str] = ()) -> DataFrame:
    """Newest ingest run of each source."""
    return top_per_group(runs, ["source"], [F.desc("started_at"), *[F.desc(c) for c in ties]], 1)


def recent(posts: DataFrame, n: int = 20) -> DataFrame:
    """Newest posts with a short preview."""
    picked = posts.orderBy(F.desc("timestamp"), F.asc("source"), F.asc("source_id")).limit(n)
    return picked.select(
        "source", "author", "timestamp", F.substring("content", 1, 120).alias("preview"), "source_url"
    )


def top_scored(posts: DataFrame, source: str, n: int = 5) -> DataFrame:
    """Newest 5n posts of one source, the n best scored of them."""
    newest = posts.where(F.col("source") == source).orderBy(F.desc("timestamp"), F.asc("source_id")).limit(5 * n)
    scored = newest.withColumn("score", engagement_score("metadata", "cli"))
    best = scored.orderBy(F.desc("score"), F.desc("timestamp"), F.asc("source_id")).limit(n)
    return best.select(
        "source", "source_id", "author", "timestamp", F.substring("content", 1, 150).alias("preview"),
        "source_url", "score",
    )


def recent_titles(articles: DataFrame, n: int = 20) -> DataFrame:
    return articles.orderBy(F.desc_nulls_last("created_at"), F.asc("ord")).limit(n).select("id", "headline")


def archive_order(articles: DataFrame) -> list[Column]:
    """Newest first, undated last; input order resolves ties."""
    return [F.desc_nulls_last("created_at"), F.asc("ord")]


def side_order(articles: DataFrame) -> DataFrame:
    return articles.orderBy(F.desc_nulls_last(F.coalesce("created_at", "placed_at")), F.asc("ord"))


def archive_view(articles: DataFrame, placement: str = "all") -> DataFrame:
    rows = articles if placement == "all" else articles.where(F.col("placement") == placement)
    return rows.orderBy(*archive_order(rows))


def order_chunk_results(results: DataFrame) -> DataFrame:
    """By first message time; chunks without one come last, by index."""
    return results.orderBy(F.asc_nulls_last("first_time"), F.asc("chunk_index"))


def timeline_order(rows: DataFrame, direction: str = "asc", ts: str = "ts") -> DataFrame:
    key = F.asc(ts) if direction == "asc" else F.desc(ts)
    return rows.orderBy(key, *[F.asc(c) for c in ("page_no", "pos") if c in rows.columns])


def numbered_by(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """Number all rows from 1, by falling ``group`` (nulls last) and ``order`` within it.

    Rows are dealt to tasks by ranges of the whole order, so a group of any size, a day or a length that most rows
    share, is ranked in many slices; only the counts of the slices meet in one sequence. The slices are written, as another
    sample of the ranges would cut them elsewhere.
    """
    along = [F.desc_nulls_last(group), *order]
    sliced = cut_lineage(rows.repartitionByRange(*along).withColumn("__slice", F.spark_partition_id()))
    counts = sliced.groupBy("__slice").agg(F.count(F.lit(1)).alias("__n"))
    earlier = W.orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("__slice", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    ranked = sliced.withColumn("__rank", F.row_number().over(W.partitionBy("__slice").orderBy(*along)))
    return ranked.join(counts, "__slice").withColumn(name, F.col("__before") + F.col("__rank")).drop("__slice", "__before", "__rank")


def archive_places(articles: DataFrame) -> DataFrame:
    """Every article with its ``place``, from 1, in archive order."""
    dated = articles.withColumn("__day", F.to_date("created_at"))
    return numbered_by(dated, "__day", archive_order(dated), "place").drop("__day")
