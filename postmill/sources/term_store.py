"""The stored term index: posting blocks in segments, one per merged batch of posts.

A block holds one term's postings in one chunk of posts, best first, with the greatest frequency and the least post
length in it. These bound any score in the block whatever the collection figures become, so they stay true as segments
are added. Posts of like length share a chunk, which keeps the bounds tight, and all terms of a post lie in the same chunk, so chunks
can be judged and read one by one. A small list names the live segments and is written last: a merge without it has not happened.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.text import search_words

BUCKETS = 64
CHUNK_POSTS = 1_024
CHUNK_WORDS = 2 << 20
TASK_WORDS = 1 << 19
CLASSES_PER_DOUBLING = 2
SEGMENT_SPAN = 1 << 40
CLASS_SPAN = 1 << 33


@dataclass(frozen=True)
class TermIndex:
    """An opened index: the live blocks, posts and replaced posts, and the collection figures."""

    blocks: DataFrame
    posts: DataFrame
    replaced: DataFrame | None
    gone: DataFrame | None
    n_docs: int
    n_words: int
    segments: list[int]


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _live(spark: SparkSession, path: str) -> tuple[list, int]:
    """The live segments with their figures, and the number of the last merge."""
    try:
        lists = spark.read.schema("segment bigint, n_docs bigint, n_words bigint, merge bigint").parquet(f"{path}/live")
        last = lists.agg(F.max("merge")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return [], 0
    # One row per segment; compaction keeps them few.
    return ([], 0) if last is None else (lists.where(F.col("merge") == last).collect(), last)


def _chunk(sizes: dict[int, int], segment: int, key: str) -> Column:
    """The chunk of a post: posts of a length class are dealt to as many chunks as ``sizes`` has for the class."""
    parts = F.create_map(*chain.from_iterable((F.lit(c), F.lit(n)) for c, n in sizes.items()))
    return F.lit(segment * SEGMENT_SPAN) + F.col("class") * F.lit(CLASS_SPAN) + F.pmod(F.xxhash64(key), F.element_at(parts, F.col("class")))


def _write_segment(tokens: DataFrame, path: str, segment: int, key: str) -> tuple[int, int]:
    """Blocks and posts of ``(key, words)`` rows; returns the number of posts and words."""
    spark = tokens.sparkSession
    at = f"{path}/posts/segment={segment}"
    tokens.select(key, F.size("words").alias("doc_len"), "words").write.mode("overwrite").parquet(at)
    posts = spark.read.parquet(at).withColumn("class", F.floor(F.log2(F.col("doc_len") + 1) * CLASSES_PER_DOUBLING).cast("int"))
    # Two classes a doubling: at most 64 rows.
    sizes = posts.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_len").alias("w")).collect()
    if sizes:
        chunk = _chunk({r["class"]: max(1, -(-r["n"] // CHUNK_POSTS), -(-r["w"] // CHUNK_WORDS)) for r in sizes}, segment, key)
        # Posts move to their chunk once, as their words would weigh more; a task counts and blocks what it holds.
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(r["w"] for r in sizes) // TASK_WORDS))
        # As one string, the words of a post are half as long.
        dealt = posts.where("doc_len > 0").select(key, "doc_len", chunk.alias("chunk"), F.array_join("words", " ").alias("line")).repartition(tasks, "chunk")
        counted = dealt.select(key, "doc_len", "chunk", F.explode(F.split("line", " ")).alias("term")).groupBy("term", "chunk", key, "doc_len").agg(
            F.count(F.lit(1)).cast("int").alias("tf")
        )
        posting = F.struct(F.col("tf"), (-F.col("doc_len")).alias("less"), F.col(key).alias("id"))
        blocks = counted.groupBy("term", "chunk").agg(
            F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("doc_len").alias("min_len"), F.sort_array(F.collect_list(posting), asc=False).alias("postings")
        ).withColumn("bucket", bucket_of(F.col("term")))
        blocks.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "chunk").write.mode("overwrite").partitionBy("bucket").parquet(
            f"{path}/blocks/segment={segment}"
        )
    return sum(r["n"] for r in sizes), sum(r["w"] for r in sizes)


def alive(rows: DataFrame, replaced: DataFrame, key: str) -> DataFrame:
    """Rows of segments that no later merge replaced under the same key."""
    ended = replaced.groupBy(F.col("id").alias(key)).agg(F.max("until").alias("until"))
    return rows.join(ended, key, "left").where("until IS NULL OR segment >= until").drop("until")


def merge_into_index(posts: DataFrame, path: str, key: str = "post_id", text: str = "content", deleted: DataFrame | None = None) -> None:
    """Add a batch of posts as a segment; posts of a known key replace what the index held, ``deleted`` keys leave it.

    What a replaced post said is known from the stored words, so term frequencies stay exact. Of several rows of one key in the
    batch one is indexed; a null text has no words, a null key is left out. Nothing but the batch and the keys of the index is read.
    """
    spark = posts.sparkSession
    live, last = _live(spark, path)
    segment = last + 1
    batch = posts.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    tokens = batch.select(key, search_words("t").alias("words"))
    n_docs, n_words = _write_segment(tokens, path, segment, key)
    rows = [(r["segment"], r["n_docs"], r["n_words"]) for r in live] + [(segment, n_docs, n_words)]
    if live:
        index = open_index(spark, path)
        changed = spark.read.parquet(f"{path}/posts/segment={segment}").select(key)
        if deleted is not None:
            changed = changed.unionByName(deleted.select(key)).distinct()
        old = index.posts.join(changed, key, "left_semi")
        if index.replaced is not None:
            old = alive(old, index.replaced, key)
        at = f"{path}/replaced/until={segment}"
        old.select(F.col(key).alias("id"), "doc_len", F.array_distinct("words").alias("words")).distinct().write.mode("overwrite").parquet(at)
        lost = spark.read.parquet(at).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("w")).first()
        rows.append((-segment, -lost["n"], -lost["w"]))
        spark.read.parquet(at).select(F.explode("words").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).withColumn(
            "bucket", bucket_of(F.col("term"))
        ).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/gone/until={segment}")
    _write_live(spark, path, rows, segment)


def _write_live(spark: SparkSession, path: str, rows: list[tuple[int, int, int]], merge: int) -> None:
    """The single file of this list makes the merge count; a negative segment stands for what that merge replaced."""
    listed = spark.createDataFrame(rows, "segment bigint, n_docs bigint, n_words bigint")
    listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/live/merge={merge}")


def open_index(spark: SparkSession, path: str) -> TermIndex | None:
    """The index as of its last finished merge; none where nothing was merged."""
    live, _ = _live(spark, path)
    if not live:
        return None
    segments = sorted(r["segment"] for r in live if r["segment"] > 0)
    until = sorted(-r["segment"] for r in live if r["segment"] < 0)
    filled = [r["segment"] for r in live if r["segment"] > 0 and r["n_words"] > 0]

    def read(kind: str, part: str, values: list[int]) -> DataFrame | None:
        paths = [f"{path}/{kind}/{part}={v}" for v in values]
        return spark.read.option("basePath", f"{path}/{kind}").parquet(*paths) if paths else None

    blocks = read("blocks", "segment", filled)
    if blocks is None:
        blocks = spark.createDataFrame([], "term string, chunk bigint, n bigint, max_tf int, min_len int, postings array<struct<tf:int,less:int,id:bigint>>, bucket int, segment int")
    changed = any(r["segment"] < 0 and r["n_docs"] for r in live)
    return TermIndex(
        blocks, read("posts", "segment", segments), read("replaced", "until", until) if changed else None, read("gone", "until", until) if changed else None,
        sum(r["n_docs"] for r in live), sum(r["n_words"] for r in live), segments,
    )


def compact_index(spark: SparkSession, path: str, key: str = "post_id") -> None:
    """Write all live posts as one segment, without what was replaced; old segments are then no longer named."""
    live, last = _live(spark, path)
    if len(live) < 2:
        return
    index = open_index(spark, path)
    posts = index.posts.select(key, "words", "segment")
    if index.replaced is not None:
        posts = alive(posts, index.replaced, key)
    segment = last + 1
    n_docs, n_words = _write_segment(posts.select(key, "words"), path, segment, key)
    _write_live(spark, path, [(segment, n_docs, n_words)], segment)
