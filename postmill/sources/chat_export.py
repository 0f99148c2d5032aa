"""Chat export files to message rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill import rules
from postmill.functions.text import CDN_URL, col, rstrip, strip
from postmill.functions.times import chat_timestamp, chat_utc, message_id

SEP = rules.EXPORT_SEPARATOR


def _records(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of each file that begin at a line starting with ``[``, with their place.

    The files are split by that delimiter while being read, so one large export is read by
    many tasks; (file, blk, n) is the reading order.
    """
    raw = spark.read.option("lineSep", "\n[").text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("blk"),
        F.monotonically_increasing_id().alias("n"), "value",
    )


def _running(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Inclusive running sum of ``value`` in reading order: within read blocks, then across them."""
    rows = rows.withColumn("__v", value)
    sums = rows.groupBy("file", "blk").agg(F.sum("__v").alias("__s"))
    prior = W.partitionBy("file").orderBy("blk").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("file", "blk", F.coalesce(F.sum("__s").over(prior), F.lit(0)).alias("__o"))
    inside = W.partitionBy("file", "blk").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    local = rows.withColumn("__l", F.sum("__v").over(inside)).join(sums, ["file", "blk"])
    return local.withColumn(name, F.col("__o") + F.col("__l")).drop("__v", "__o", "__l")


def read_chat_export(spark: SparkSession, path: str) -> DataFrame:
    """Message rows (channel, ordinal, header, author, ts_kst, content, block) of export files.

    The body runs from the second separator line to the third, or is the whole file when there
    are fewer than two. A line that merely starts with ``[`` belongs to the message before it.
    Ordinal -1 is the text before the first header.
    """
    rows = _records(spark, path)
    rows = _running(rows.withColumn("seps", F.regexp_count("value", F.lit(SEP))), "seps_through", F.col("seps"))
    place = F.struct("blk", "n")
    files = rows.groupBy("file").agg(
        (F.sum("seps") >= 2).alias("has_head"), F.min(place).alias("first"), F.max(place).alias("last")
    )
    rows = rows.join(files, "file").withColumn("seps_before", F.col("seps_through") - F.col("seps"))
    headed, is_last = F.col("has_head"), place == F.col("last")
    # Section 2 is the body; in the piece where it opens or closes, only that part of the text.
    part = F.greatest(2 - F.col("seps_before"), F.lit(0)).cast("int")
    parts = F.split("value", SEP)
    text = F.when(headed, F.get(parts, part)).otherwise(F.col("value"))
    goes_on = F.when(headed, F.col("seps_before") == 2).otherwise(place != F.col("first"))
    runs_out = headed & (F.size(parts) > part + 1)
    pieces = rows.where(~headed | ((F.col("seps_before") <= 2) & (F.col("seps_through") >= 2))).select(
        "file", "blk", "n",
        F.concat(
            F.when(goes_on, "[").otherwise(""), F.when(is_last, rstrip(text)).otherwise(text),
            F.when(is_last | runs_out, "").otherwise("\n"),
        ).alias("block"),
    )
    is_header = F.col("block").rlike(rules.CHAT_HEADER)
    numbered = _running(pieces, "ordinal", is_header.cast("bigint"))
    whole = numbered.groupBy(F.col("file").alias("channel"), (F.col("ordinal") - 1).alias("ordinal")).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("blk", "n", "block"))), lambda x: x["block"]), ""
        ).alias("block")
    )
    header = F.regexp_extract("block", rules.CHAT_HEADER + "[^\n]*", 0)
    return message_fields(whole.withColumn("header", F.when(F.col("ordinal") >= 0, header)))


def message_fields(blocks: DataFrame) -> DataFrame:
    """Author, KST time and content of message blocks."""
    tail = F.regexp_replace("header", rules.CHAT_HEADER + r"\s*", "")
    content = F.substr("block", F.length("header") + 1)
    return blocks.select(
        "channel", "ordinal", "header", strip(tail).alias("author"), chat_timestamp("header").alias("ts_kst"),
        strip(F.when(F.col("ordinal") >= 0, content)).alias("content"), "block",
    )


def normalize_chat(messages: DataFrame, metadata: dict[str, str], fetched_at: Column) -> DataFrame:
    """Messages as posts with a hashed id and UTC time; empty messages are dropped."""
    named = messages.where((F.col("ordinal") >= 0) & (strip("content") != "") & (F.col("author") != ""))
    return named.select(
        F.lit("discord").alias("source"), message_id("ts_kst", "author", "content").alias("source_id"),
        F.lit(None).cast("string").alias("source_url"), "author", "content", chat_utc("ts_kst").alias("timestamp"),
        F.lit(None).cast("string").alias("parent_id"),
        F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in metadata.items()])).alias("metadata"),
        fetched_at.alias("fetched_at"),
    )


def clean_lines(block: Column | str) -> Column:
    """Header line and the body lines left after removing markers, CDN links and blank lines."""
    lines = F.split(col(block), r"\r?\n")
    body = F.transform(
        F.filter(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda x: ~strip(x).isin(rules.CHAT_MARKERS)),
        lambda x: rstrip(F.regexp_replace(x, CDN_URL, "")),
    )
    body = F.filter(body, lambda x: (strip(x) != "") & ~strip(x).isin(rules.CHAT_MARKERS))
    kept = rstrip(F.array_join(F.concat(F.slice(lines, 1, 1), body), "\n"))
    return F.when(F.size(body) > 0, kept)


def clean_message_blocks(exports: DataFrame, key: str = "file", text: str = "body") -> DataFrame:
    """(key, pos, block) of export bodies: blocks parted by blank lines that start with ``[`` and say something."""
    blocks = exports.select(key, F.posexplode(F.split(text, r"\n{3,}")).alias("pos", "raw"))
    stripped = blocks.withColumn("raw", F.btrim("raw", F.lit("\n"))).where(F.startswith("raw", F.lit("[")))
    return stripped.select(key, "pos", clean_lines("raw").alias("block")).where("block IS NOT NULL")
