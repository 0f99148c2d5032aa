"""Queries that write files and read them back: drops, chat exports, state documents, snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from postmill import rules, schemas
from postmill.operators import chunking
from postmill.plans import bindings as b
from postmill.plans.registry import SQL_WS, given, query
from postmill.session import shared_folder, ship
from postmill.sources import chat_export, state, store
from postmill.streaming import ingest

_BLANK = f"trim(content, {SQL_WS})"


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _dropped(spark, sf):
    """Posts as JSON lines in a folder of drops: every tenth is no JSON, every seventh has no content."""
    p = b.posts(spark, sf)
    content = F.when(F.col("post_id") % 7 == 0, "").otherwise(F.col("content"))
    stamp = F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    line = F.to_json(F.struct("source", "source_id", content.alias("content"), stamp.alias("timestamp"), "metadata", stamp.alias("fetched_at")))
    drops = _folder(spark, "drops")
    p.select(F.when(F.col("post_id") % 10 == 9, F.concat(F.lit("no json "), "source_id")).otherwise(line).alias("value")).write.text(drops)
    return drops


def _ingested(spark, sf):
    at = _folder(spark, "ingest")
    ingest.stream_ingest(spark, _dropped(spark, sf), f"{at}/store", f"{at}/checkpoint", f"{at}/runs").awaitTermination()
    return at


@query("ingest_runs", given("posts") + """
    SELECT CASE WHEN post_id % 10 = 9 THEN 'unknown' ELSE source END AS source, 'success' AS status, count(*) AS rows_read,
           count(*) FILTER (WHERE post_id % 10 <> 9 AND post_id % 7 <> 0 AND content <> '') AS rows_inserted,
           count(*) FILTER (WHERE NOT (post_id % 10 <> 9 AND post_id % 7 <> 0 AND content <> '')) AS rows_skipped
    FROM posts GROUP BY ALL UNION ALL SELECT 'gone', 'error', 0, 0, 0""")
def ingest_runs(spark, sf):
    """A stream of drops by source, and a run whose files are not there."""
    at = _ingested(spark, sf)
    ingest.logged_run(spark, "gone", lambda: spark.read.schema(schemas.RAW_POSTS).json(f"{at}/nowhere"), f"{at}/store", f"{at}/runs")
    return ingest.read_runs(spark, f"{at}/runs").select("source", "status", "rows_read", "rows_inserted", "rows_skipped")


@query("streamed_posts", given("posts") + """
    SELECT source, CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS dt, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars, max(source_id) AS last_id
    FROM posts WHERE post_id % 10 <> 9 AND post_id % 7 <> 0 AND content <> '' GROUP BY ALL""")
def streamed_posts(spark, sf):
    rows = store.read_store(spark, f"{_ingested(spark, sf)}/store")
    return rows.groupBy("source", F.col("dt").cast("string").alias("dt")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"), F.max("source_id").alias("last_id")
    )


@query("chat_export_messages", given("messages") + f"""
    SELECT CAST(CAST(channel AS BIGINT) % 8 AS INTEGER) AS file, row_number() OVER (PARTITION BY CAST(channel AS BIGINT) % 8 ORDER BY CAST(channel AS BIGINT), ordinal) - 1 AS ordinal,
           author, ts_kst, {_BLANK} AS content FROM messages""")
def chat_export_messages(spark, sf):
    """The messages written as eight export files and read back."""
    m = b.messages(spark, sf)
    hour = F.hour("ts_kst")
    header = F.concat(
        F.lit("["), F.date_format("ts_kst", "yyyy. M. d. "), F.when(hour < 12, "오전 ").otherwise("오후 "), ((hour + 11) % 12 + 1).cast("string"),
        F.date_format("ts_kst", ":mm"), F.lit("] "), "author",
    )
    file, conv = (F.col("channel").cast("bigint") % 8).cast("int").alias("file"), F.col("channel").cast("bigint").alias("conv")
    bodies = m.select(file, conv, F.col("ordinal").cast("bigint").alias("turn"), F.concat(header, F.lit("\n"), "content", F.lit("\n")).alias("value"))
    head = f"{rules.EXPORT_SEPARATOR}\nGuild: g\nChannel: c\n{rules.EXPORT_SEPARATOR}\n"
    heads = bodies.select("file").distinct().select("file", F.lit(-1).cast("bigint").alias("conv"), F.lit(0).cast("bigint").alias("turn"), F.lit(head).alias("value"))
    at = _folder(spark, "exports")
    # A file is one stream of its messages, in order.
    both = heads.unionByName(bodies).repartition("file").sortWithinPartitions("file", "conv", "turn")
    both.select("value", "file").write.partitionBy("file").text(at)
    read = chat_export.read_chat_export(spark, at).where("ordinal >= 0")
    return read.select(F.regexp_extract("channel", "file=([0-9]+)", 1).cast("int").alias("file"), "ordinal", "author", "ts_kst", "content")


@query("state_articles", given("articles") + """
    SELECT CAST(ord // 500 AS INTEGER) AS doc, id, headline, category, trust, placement, created_at,
           row_number() OVER (PARTITION BY ord // 500 ORDER BY ord) - 1 AS place FROM articles""")
def state_articles(spark, sf):
    """The articles as state documents of 500 at most, written as files and read back."""
    a = b.articles(spark, sf).withColumn("doc", F.floor(F.col("ord") / 500).cast("int"))
    utc = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fields = ["id", "headline", "body", "category", "trust", "created_at", "placement", "placed_at"]
    one = F.struct("ord", "id", "headline", "body", "category", "trust", utc.alias("created_at"), "placement", utc.alias("placed_at"))
    listed = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    value = F.to_json(F.struct(F.lit(2).alias("schema_version"), F.lit("Daily Mill").alias("journal"), "articles"))
    at = _folder(spark, "states")
    a.groupBy("doc").agg(listed.alias("articles")).select("doc", value.alias("value")).write.partitionBy("doc").text(at)
    _, articles, _ = state.read_state(spark, at)
    return articles.select(
        "doc", "id", "headline", "category", "trust", "placement", F.col("created_at").cast("timestamp_ntz").alias("created_at"), F.col("ord").alias("place")
    )


@query("snapshot_newest", given("articles") + """
    SELECT 3 AS version, category, count(*) AS n FROM articles WHERE ord % 4 < 3 GROUP BY category""")
def snapshot_newest(spark, sf):
    """Three snapshots of growing parts of the articles, of which two stay; the newest is read."""
    a, at = b.articles(spark, sf).select("id", "ord", "category"), _folder(spark, "snapshots")
    for version in (1, 2, 3):
        state.save_snapshot(a.where(F.col("ord") % 4 < version), at, version, keep=2)
    newest = max(state.snapshot_versions(spark, at))
    return state.read_snapshot(spark, at).groupBy("category").agg(F.count(F.lit(1)).alias("n")).select(F.lit(newest).alias("version"), "category", "n")


def _summary(row):
    """A stand-in for a model: says how long a message is, and fails on every seventh turn."""
    if int(row["ordinal"].iat[0]) % 7 == 6:
        raise RuntimeError("no reply")
    return row.assign(n_chars=row["content"].str.len())[["n_chars"]]


@query("annotate_resumed", given("messages") + """
    SELECT channel, ordinal, CASE WHEN ordinal % 7 = 6 THEN NULL ELSE length(content) END AS n_chars, CASE WHEN ordinal % 7 = 6 THEN 3 END AS attempts,
           CASE WHEN ordinal % 7 = 6 THEN 'RuntimeError: no reply' END AS error FROM messages""")
def annotate_resumed(spark, sf):
    """Half of the messages are annotated, then all: the second run calls what is missing."""
    m, at = b.messages(spark, sf).select("channel", "ordinal", "content"), _folder(spark, "outcomes")
    chunking.annotate_stored(m.where("ordinal % 2 = 0"), _summary, "n_chars bigint", at, attempts=3)
    results, failed = chunking.annotate_stored(m, _summary, "n_chars bigint", at, attempts=3)
    none = F.lit(None)
    return results.select("channel", "ordinal", "n_chars", none.cast("int").alias("attempts"), none.cast("string").alias("error")).unionByName(
        failed.select("channel", "ordinal", none.cast("bigint").alias("n_chars"), "attempts", "error")
    )


ship(__name__)
