"""Counts, bounds and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill import rules
from postmill.functions.scores import engagement_score, score_text
from postmill.functions.text import blank_to_null, preview, rstrip, strip
from postmill.functions.times import Moment, hours, kst_date, moment
from postmill.operators.filters import since
from postmill.operators.ranking import top_per_group


def source_stats(posts: DataFrame) -> DataFrame:
    """Count, oldest and newest post per source."""
    grouped = posts.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest")
    )
    return grouped.orderBy(F.desc("n"), F.asc("source"))


def source_counts_since(posts: DataFrame, as_of: Moment, spec: str) -> DataFrame:
    grouped = since(posts, as_of, spec).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return grouped.orderBy(F.desc("n"), F.asc("source"))


def count_posts(posts: DataFrame) -> DataFrame:
    return posts.agg(F.count(F.lit(1)).alias("n"))


def source_breakdown(posts: DataFrame) -> DataFrame:
    return posts.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("source"))


def ingest_report(valid: DataFrame, rejected: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Per source: rows read, rejected, newly stored, and not new (already known or repeated)."""
    parts = [("valid", valid), ("rejected", rejected), ("stored_before", before), ("stored_after", after)]
    tagged = None
    for name, df in parts:
        part = df.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(name))
        tagged = part if tagged is None else tagged.unionByName(part)
    wide = tagged.groupBy("source").agg(
        *[F.coalesce(F.sum(F.when(F.col("part") == n, F.col("n"))), F.lit(0)).alias(n) for n, _ in parts]
    )
    inserted = F.col("stored_after") - F.col("stored_before")
    return wide.select(
        "source", (F.col("valid") + F.col("rejected")).alias("rows_read"), "rejected",
        inserted.alias("inserted"), (F.col("valid") - inserted).alias("not_new"),
    )


def label_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def label_counts_wide(df: DataFrame, column: str, labels: list[str]) -> DataFrame:
    """One row with a count per known label."""
    return df.agg(*[F.count(F.when(F.col(column) == label, 1)).alias(label) for label in labels])


def context_selection(posts: DataFrame, as_of: Moment, days: int = 3, per_source: int = 15) -> DataFrame:
    """Best recent posts per source as prompt entries, with how many each source gave."""
    fresh = posts.where(F.col("timestamp") > moment(as_of, posts, "timestamp") - F.make_dt_interval(F.lit(days)))
    scored = fresh.withColumn("score", engagement_score("metadata", "py"))
    order = [F.desc("score"), F.desc("timestamp"), F.asc("source_id")]
    picked = top_per_group(scored, ["source"], order, per_source, rank="rank")
    text = F.coalesce("content", F.lit(""))
    entry = F.concat(
        F.lit("["), F.col("source"), F.lit("] ("), score_text("score"), F.lit(") "), preview(text, 350)
    )
    counted = picked.withColumn("n_source", F.count(F.lit(1)).over(W.partitionBy("source")))
    return counted.select("source", "rank", "score", entry.alias("entry"), "n_source").orderBy("source", "rank")


def context_counts(context: DataFrame) -> DataFrame:
    return context.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def fallback_title(headline: Column) -> Column:
    """First headline cut at 42 characters with an ellipsis."""
    first = strip(headline)
    cut = F.concat(rstrip(F.substring(first, 1, 42), " .,…"), F.when(F.length(first) > 42, "…").otherwise(""))
    return F.coalesce(blank_to_null(F.when(first != "", cut)), F.lit(rules.SUMMARY_TITLE_DEFAULT))


def summary_fallback(runs: DataFrame, articles: DataFrame, key: str = "run_date", order: str = "ord", shown: int = 10) -> DataFrame:
    """Title and body per run, built from its first new articles; fixed texts for empty runs."""
    picked = top_per_group(articles.select(key, order, "headline", "category", "trust"), [key], [F.asc(order)], shown, rank="rank")
    totals = articles.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    label = F.concat(
        strip(F.coalesce("headline", F.lit(""))), F.lit("("),
        F.when(F.col("category") == "rumor", rules.LABEL_RUMOR).otherwise(rules.LABEL_NEWS), F.lit(", "),
        F.when(F.col("trust") == "low", rules.LABEL_LOW).otherwise(rules.LABEL_HIGH), F.lit(")"),
    )
    lines = picked.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("rank", label.alias("label")))).alias("items"),
        F.max(F.when(F.col("rank") == 1, F.coalesce("headline", F.lit("")))).alias("first"),
    )
    rest = F.col("n") - shown
    parts = F.concat(
        F.transform("items", lambda x: x["label"]),
        F.when(rest > 0, F.array(F.concat(F.lit(rules.SUMMARY_REST_HEAD), rest.cast("string"), F.lit(rules.SUMMARY_REST_TAIL))))
        .otherwise(F.array().cast("array<string>")),
    )
    body = F.concat(F.lit(rules.SUMMARY_BODY_HEAD), F.array_join(parts, ", "), F.lit(rules.SUMMARY_BODY_TAIL))
    joined = runs.select(key).join(lines, key, "left").join(totals, key, "left")
    return joined.select(
        key,
        F.when(F.col("n").isNull(), F.lit(rules.SUMMARY_TITLE_EMPTY)).otherwise(fallback_title(F.col("first"))).alias("title"),
        F.when(F.col("n").isNull(), F.lit(rules.SUMMARY_BODY_EMPTY)).otherwise(body).alias("body"),
        F.coalesce("n", F.lit(0)).alias("article_count"),
    )


def merge_report(candidates: DataFrame, mentions: DataFrame, discards: DataFrame, finals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Progress of a merge loop: (one row per round, totals).

    ``finals`` are (round, final_no); ``mentions`` (round, id) and ``discards`` (round, id) hold resolved ids.
    """
    touched = mentions.select("round", "id").unionByName(discards.select("round", "id"))
    settled = touched.groupBy("id").agg(F.min("round").alias("round")).join(candidates.select("id"), "id", "left_semi")
    total = candidates.agg(F.count(F.lit(1)))
    per_round = (
        finals.groupBy("round").agg(F.count(F.lit(1)).alias("new_finals"))
        .join(discards.groupBy("round").agg(F.countDistinct("id").alias("new_discards")), "round", "full")
        .join(settled.groupBy("round").agg(F.count(F.lit(1)).alias("settled")), "round", "full")
    )
    # One row per round.
    before = F.sum(F.coalesce("settled", F.lit(0))).over(W.orderBy("round").rowsBetween(W.unboundedPreceding, -1))
    rounds = per_round.select(
        "round", (total.scalar() - F.coalesce(before, F.lit(0))).alias("candidate_count"),
        F.coalesce("new_finals", F.lit(0)).alias("new_finals"), F.coalesce("new_discards", F.lit(0)).alias("new_discards"),
    )
    totals = finals.agg(F.count(F.lit(1)).alias("final_count")).select(
        "final_count",
        discards.agg(F.countDistinct("id")).scalar().alias("discard_count"),
        (total.scalar() - settled.agg(F.count(F.lit(1))).scalar()).alias("still_unreferenced_count"),
    )
    return rounds, totals


def noise_audit(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Exporter leftovers per file: markers and CDN links still present."""
    def hits(needle: str) -> Column:
        return F.sum(F.regexp_count(F.col(text), F.lit(r"\Q" + needle + r"\E"))).cast("bigint")

    markers = [hits(m).alias(m.strip("{}").lower().replace(" ", "_")) for m in rules.CHAT_MARKERS]
    links = [hits(p).alias(n) for n, p in rules.CDN_PREFIXES.items()]
    return texts.groupBy(key).agg(*markers, *links)


def time_bounds(rows: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Earliest and latest time per key with the label ``a ~ b``; unknown times show ``?``."""
    grouped = rows.groupBy(*keys).agg(F.min(ts).alias("earliest"), F.max(ts).alias("latest"))
    show = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm"), F.lit("?"))
    return grouped.withColumn("label", F.concat(show("earliest"), F.lit(" ~ "), show("latest")))


def cluster_checks(clusters: DataFrame) -> DataFrame:
    """Whether keep and drop split the ids of every cluster, and the cluster has two members."""
    both = F.array_union("keep", "drop")
    return clusters.withColumn(
        "covers", (F.size(F.array_except(both, "ids")) == 0) & (F.size(F.array_except("ids", both)) == 0)
    ).withColumn("disjoint", F.size(F.array_intersect("keep", "drop")) == 0).withColumn(
        "big_enough", F.size(F.array_distinct("ids")) >= 2
    )


def run_failures(runs: DataFrame, as_of: Moment, window_hours: int = 24) -> DataFrame:
    recent = F.col("started_at") > moment(as_of, runs, "started_at") - hours(window_hours)
    return runs.where((F.col("status") == "error") & recent).orderBy(F.desc("started_at"), F.asc("source"))


def period(results: DataFrame) -> DataFrame:
    """Start of the first and end of the last chunk label, in chunk order."""
    place = F.struct(F.col("first_time").isNull().alias("late"), F.col("first_time"), F.col("chunk_index"))
    ends = results.agg(F.min_by("label", place).alias("a"), F.max_by("label", place).alias("b"))
    return ends.select(
        strip(F.substring_index("a", "~", 1)).alias("start"), strip(F.substring_index("b", "~", -1)).alias("end")
    )


def missing_daily_slots(runs: DataFrame, start: str, end: str, as_of: Moment, hour: int = 8) -> DataFrame:
    """KST days from ``start`` to ``end`` whose slot has passed without a run of that day."""
    days = runs.sparkSession.range(1).select(
        F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("day")
    )
    now_kst = moment(as_of, runs, "started_at") + hours(9)
    due = days.where(F.col("day").cast(runs.schema["started_at"].dataType) + hours(hour) <= now_kst)
    ran = runs.select(kst_date("started_at").alias("day"))
    return due.join(ran, "day", "left_anti")


