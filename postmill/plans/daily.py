"""The daily run, from message chunks to the placed front page.

Model calls happen outside: ``chunks`` go out, replies come back as tables. Each function is
one stage and materialises its articles in the shared checkpoint folder, as the next model call
and several later joins read them again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.times import Moment, moment
from postmill.operators import dedup, guards, lookups, numbering, placement, replies
from postmill.operators.filters import decision_log_retention
from postmill.session import cut_lineage


def new_candidates(scan_replies: DataFrame, run_at: Column) -> DataFrame:
    """Articles of the scan replies (reply_id, chunk_index, raw) with batch ids, before any merging."""
    parsed, _ = replies.parse_article_replies(scan_replies)
    placed = parsed.join(scan_replies.select("reply_id", "chunk_index"), "reply_id")
    numbered = numbering.assign_ids(placed, run_at)
    return cut_lineage(numbered.select(
        "id", F.col("seq").alias("ord"), "headline", "body", "category", "trust", run_at.alias("created_at"),
        F.lit(None).cast("string").alias("placement"), run_at.alias("placed_at"),
    ))


def without_duplicates(candidates: DataFrame, existing: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Exact and near duplicates removed within the batch, repeated releases against ``existing``."""
    distinct = dedup.near_dup_dedup(dedup.exact_title_dedup(candidates), threshold)
    kept, _ = guards.product_story_guard(distinct, existing)
    return cut_lineage(dedup.longest_first(kept))


def drop_by_clusters(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Candidates left after duplicate clusters of model replies (reply_id, raw)."""
    refs = replies.parse_verdict_replies(verdicts, "clusters").withColumn("pos", F.lit(0))
    resolved, _ = lookups.resolve_short_ids(refs, candidates)
    return cut_lineage(lookups.apply_drops(candidates, resolved)[0])


def drop_by_cross_check(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Candidates left after ``N<number>`` verdicts; numbers count the candidates in ``ord`` order."""
    numbers = replies.parse_verdict_replies(verdicts, "cross").select((F.col("number") - 1).alias("__n"))
    counted = numbering.with_offsets(candidates, [], "ord", {"__n": F.lit(1)})
    return cut_lineage(counted.join(numbers, "__n", "left_anti").select(candidates.columns))


@dataclass
class Placed:
    """Outcome of a placement stage."""

    articles: DataFrame
    decision_log: DataFrame
    rejected: DataFrame
    log_placements: DataFrame


def place(
    existing: DataFrame, new: DataFrame, reply: DataFrame, shown: DataFrame, log: DataFrame, as_of: Moment
) -> Placed:
    """Place all articles from one placement reply (reply_id, raw).

    ``shown`` maps the short ids of the prompt to articles: (reply_id, short, id). When the
    reply is rejected, existing articles keep their placement and new ones go to the side.
    ``existing`` and ``new`` share columns and have distinct ``ord``, existing first.
    """
    rows, unread = replies.parse_placement_replies(reply)
    readable = reply.select("reply_id").join(unread, "reply_id", "left_anti")
    valid = shown.select("reply_id", F.col("short").alias("id"))
    decided, rejected = placement.validate_placements(rows, valid, readable)
    named = decided.withColumnRenamed("id", "short").join(shown, ["reply_id", "short"]).select("id", "placement")
    everything = existing.unionByName(new)
    given = everything.select("id", F.col("placement").alias("before")).join(named, "id", "left").select(
        "id", F.coalesce("placement", "before", F.lit("side")).alias("placement")
    )
    front = placement.front_page(everything.drop("placement"), new, given).select("id", "slot", F.col("placement").alias("decided"))
    now = moment(as_of, everything, "created_at")
    updated = lookups.apply_placements(everything, front.withColumnRenamed("decided", "placement"), now)
    articles = updated.join(front.select("id", "slot"), "id")
    # A run without new rows leaves no entry.
    entry = new.agg(F.count(F.lit(1)).cast("int").alias("new_count")).where("new_count > 0").select(
        moment(as_of, log, "run_at").alias("run_at"), "new_count"
    )
    shown_at = placement.placement_log(articles, moment(as_of, log, "run_at"))
    logged = shown_at.join(entry.select("run_at"), "run_at", "left_semi")
    if "placements" in log.columns:
        # Entries read from state documents keep their map; the placements of this one are rows.
        entry = entry.withColumn("placements", F.lit(None).cast(log.schema["placements"].dataType))
    return Placed(articles, decision_log_retention(log, as_of, entry), rejected, logged)
