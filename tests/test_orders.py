"""The order in which views come, ties and nulls included."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postmill.operators import dedup, merges, ranking

ARTICLES = "id string, ord int, placement string, created_at timestamp, placed_at timestamp"


def at(day):
    return None if day is None else datetime(2026, 4, day)


@pytest.fixture(scope="module")
def articles(spark):
    rows = [("a", 0, "main", 3, 9), ("b", 1, "side", None, 5), ("c", 2, "main", 5, 1), ("d", 3, "main", None, None), ("e", 4, "main", 3, 2), ("f", 5, "side", 4, None), ("g", 6, None, 5, 1)]
    return spark.createDataFrame([(i, o, p, at(c), at(q)) for i, o, p, c, q in rows], ARTICLES).repartition(3)


def ids(df, column="id"):
    return "".join(str(r[column]) for r in df.collect())


def test_archive_view(articles):
    assert ids(ranking.archive_view(articles)) == "cgfaebd" and ids(ranking.archive_view(articles, "main")) == "caed"


def test_side_order(articles):
    assert ids(ranking.side_order(articles)) == "bcgfaed"


def test_recent_titles(articles):
    assert ids(ranking.recent_titles(articles.withColumn("headline", F.col("id")), 3)) == "cgf"


def test_chunk_results(spark):
    rows = [(0, None), (1, "09:00"), (2, "08:00"), (3, None), (4, "09:00")]
    df = spark.createDataFrame(rows, "chunk_index int, first_time string").repartition(3)
    assert ids(ranking.order_chunk_results(df), "chunk_index") == "21403"


def test_timeline(spark):
    rows = [(1, 0, 5), (1, 1, 7), (2, 0, 5), (2, 1, None)]
    df = spark.createDataFrame(rows, "page_no int, pos int, ts int").repartition(3)
    assert [(r.page_no, r.pos) for r in ranking.timeline_order(df).collect()] == [(2, 1), (1, 0), (2, 0), (1, 1)]
    assert [(r.page_no, r.pos) for r in ranking.timeline_order(df, "desc").collect()] == [(1, 1), (1, 0), (2, 0), (2, 1)]


def test_base_then_tail(spark):
    base, tail = (spark.createDataFrame([(i,) for i in order], "ordinal int").repartition(3) for order in ([2, 0, 1], [1, 0]))
    assert [(r.part, r.ordinal) for r in merges.concat_base_tail(base, tail).collect()] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]


def test_one_day_and_one_length_are_numbered_in_slices(spark):
    rng = random.Random(4)
    order = rng.sample(range(5000), 5000)
    df = spark.createDataFrame([(f"a{o}", o, "x" if o % 50 else None, datetime(2026, 4, 1) if o % 7 else None) for o in order], "id string, ord int, body string, created_at timestamp")
    placed = ranking.archive_places(df)
    got = {r.ord: r.place for r in placed.collect()}
    want = sorted(order, key=lambda o: (o % 7 == 0, o))
    assert [got[o] for o in want] == list(range(1, 5001))
    longest = {r.id: r.ord for r in dedup.longest_first(df).collect()}
    assert [longest[f"a{o}"] for o in sorted(order, key=lambda o: (o % 50 == 0, o))] == list(range(5000))
    # More than one task ranks the one day, where tasks are not merged for being small.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sliced = df.repartitionByRange(F.desc_nulls_last(F.to_date("created_at")), *ranking.archive_order(df)).withColumn("s", F.spark_partition_id())
    assert sliced.where("created_at IS NOT NULL").select("s").distinct().count() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranking.archive_places(df.limit(0)).count() == 0
