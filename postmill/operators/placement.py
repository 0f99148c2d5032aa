"""Front-page placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.times import kst_date
from postmill.operators.guards import is_weak
from postmill.operators.ranking import top_per_group

MAX_MAIN = 6
SLOTS = 1 + MAX_MAIN


def validate_placements(placed: DataFrame, valid: DataFrame, readable: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(placements, rejected replies) from rows (reply_id, group, pos, id) and valid (reply_id, id).

    ``readable`` (reply_id) are the replies that parsed: one that names no id puts everything on the side.

    Every id counts once, in its best group; one top, six mains, the overflow moves down,
    ids a reply forgot go to the side. A reply naming an unknown id is rejected whole.
    Only top and main are ranked, by group limits; the side list needs no order.
    """
    rank = F.when(F.col("group") == "top", 0).when(F.col("group") == "main", 1).otherwise(2)
    named = placed.groupBy("reply_id", "id").agg(F.min(F.struct(rank.alias("g"), F.col("pos"))).alias("p"))
    rejected = named.join(valid, ["reply_id", "id"], "left_anti").select("reply_id").distinct()
    sound = named.join(rejected, "reply_id", "left_anti").select("reply_id", "id", "p.g", "p.pos")
    top = top_per_group(sound.where("g = 0"), ["reply_id"], [F.asc("pos")], 1, rank="slot")
    # Extra tops queue behind the mains.
    queue = sound.where("g <= 1").join(top.select("reply_id", "id"), ["reply_id", "id"], "left_anti")
    main = top_per_group(queue, ["reply_id"], [F.desc("g"), F.asc("pos")], MAX_MAIN, rank="slot")
    front = top.select("reply_id", "id", F.lit("top").alias("placement"), "slot").unionByName(
        main.select("reply_id", "id", F.lit("main").alias("placement"), "slot")
    )
    heard = sound.select("reply_id") if readable is None else readable.select("reply_id").join(rejected, "reply_id", "left_anti")
    accepted = valid.join(heard.distinct(), "reply_id", "left_semi")
    placements = accepted.join(front, ["reply_id", "id"], "left").withColumn(
        "placement", F.coalesce("placement", F.lit("side"))
    )
    return placements, rejected


def front_page(articles: DataFrame, new: DataFrame, placements: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Placements and display order of all articles (``id``, ``ord``, ...): new strong stories first.

    Only the front slots need a global order; they come from one top-k, and the rest of the
    display order is the sort key (slot, side_at desc, ord). Without new rows nothing changes.
    """
    rank = F.when(F.col("__given") == "top", 0).when(F.col("__given") == "main", 1).otherwise(2)
    fresh = new.select("id").withColumn("is_new", F.lit(True))
    joined = articles.join(fresh, "id", "left").join(
        placements.select("id", F.col("placement").alias("__given")), "id", "left"
    ).withColumn("is_new", F.coalesce("is_new", F.lit(False)))
    bucket = (
        F.when(F.col("is_new") & ~is_weak(), 0).when(~is_weak(), 1).when(F.col("is_new"), 2).otherwise(3)
    )
    keyed = joined.withColumn("__bucket", bucket).withColumn("__rank", rank)
    best = keyed.select("id", "__bucket", "__rank", "ord").orderBy("__bucket", "__rank", "ord").limit(slots)
    # The front is one array of at most ``slots`` ids.
    front = best.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__bucket", "__rank", "ord", "id"))), lambda x: x["id"]).alias("ids")
    ).scalar()
    any_new = F.coalesce(fresh.limit(1).select("is_new").scalar(), F.lit(False))
    slot = F.nullif(F.array_position(front, F.col("id")), F.lit(0))
    decided = F.when(slot == 1, "top").when(slot > 1, "main").otherwise("side")
    epoch = F.lit("1970-01-01").cast(articles.schema["created_at"].dataType)
    return joined.withColumns({
        "slot": F.when(any_new, slot),
        "placement": F.when(any_new, decided).otherwise(F.col("__given")),
        "side_at": F.when(any_new, F.coalesce("created_at", epoch)),
    }).drop("__given")


def display_order(placed: DataFrame) -> DataFrame:
    """Front slots, then the side by creation time; input order when nothing was new."""
    return placed.orderBy(F.asc_nulls_last("slot"), F.desc("side_at"), F.asc("ord"))


def date_dividers(articles: DataFrame) -> DataFrame:
    """Flag the first row of each KST date within every placement view, newest first.

    The first row of a date is its newest, so a grouped maximum finds it without ordering
    a whole view in one task.
    """
    views = articles.withColumn("view", F.explode(F.array(F.lit("all"), F.col("placement")))).where("view IS NOT NULL")
    dated = views.withColumn("day", kst_date("created_at"))
    place = F.struct(F.col("created_at"), (-F.col("ord")).alias("back"))
    first = dated.groupBy("view", "day").agg(F.max_by("id", place).alias("first_id"))
    first = first.withColumnsRenamed({"view": "f_view", "day": "f_day"})
    on = (F.col("view") == F.col("f_view")) & F.col("day").eqNullSafe(F.col("f_day"))
    return dated.join(first, on).select(
        "view", "id", "ord", "created_at", "day", (F.col("id") == F.col("first_id")).alias("divider")
    )


def placement_log(articles: DataFrame, run_at: Column) -> DataFrame:
    """Where a run put every article, (run_at, id, placement): rows beside the decision log, as a map would grow with the archive."""
    return articles.select(run_at.alias("run_at"), "id", "placement")
