"""Results that once depended on a cap."""

import os
import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from postmill.operators import anchors, dedup, evidence, filters, numbering, placement

ROOT = Path(__file__).resolve().parents[1]


def test_more_than_a_thousand_articles_in_one_reply(spark):
    rows = spark.range(1203).select(F.when(F.col("id") < 1001, 0).otherwise(1).alias("chunk_index"), (F.col("id") % 1001).alias("pos"), F.col("id").alias("n"))
    got = numbering.assign_ids(rows, F.lit("2026-04-20 09:00:00").cast("timestamp")).collect()
    assert {r.n: r.seq for r in got} == {i: i + 1 for i in range(1203)}
    assert {r.id for r in got if r.n in (0, 1200)} == {"art-202604200900-01", "art-202604200900-1201"}


def test_keywords_with_blanks_and_of_one_character(spark):
    keywords = spark.createDataFrame([(1, "open source"), (2, "x"), (3, "Open"), (4, " "), (5, "n s")], "id int, keyword string")
    messages = spark.createDataFrame([("c", 0, "we like Open  source"), ("c", 1, "and open source"), ("c", 2, "axe"), ("c", 3, "opens")], "channel string, ordinal int, block string")
    got = {r.id: r.snippets for r in evidence.keyword_snippets(keywords, messages).collect()}
    assert got == {1: "and open source", 2: "axe", 3: "we like Open  source\nand open source\nopens", 4: "", 5: "and open source"}


def test_chain_of_similar_titles(spark):
    # Each title shares two of its three words with the next: every second one stays.
    rows = [(f"a{i}", i, f"w{i} w{i + 1} w{i + 2}", "b") for i in range(40)]
    df = spark.createDataFrame(rows, "id string, ord bigint, headline string, body string")
    got = {r.id for r in dedup.near_dup_dedup(df, 0.4).collect()}
    assert got == {f"a{i}" for i in range(0, 40, 2)}


def test_finals_with_the_same_wishes(spark):
    rows = [(1, f, f"id{w}", w) for f in range(12) for w in range(12)]
    got = anchors.assign_anchors(spark.createDataFrame(rows, "run_id int, final_no int, id string, wish int")).collect()
    assert {r.final_no: r.id for r in got} == {i: f"id{i}" for i in range(12)}


def test_longest_body_first(spark):
    df = spark.createDataFrame([("a", 0, "xx"), ("b", 1, "xxx"), ("c", 2, None), ("d", 3, "xx")], "id string, ord bigint, body string")
    assert {r.id: r.ord for r in dedup.longest_first(df).collect()} == {"b": 0, "a": 1, "d": 2, "c": 3}


def test_empty_placement_reply_puts_all_on_the_side(spark):
    valid = spark.createDataFrame([("r", "a"), ("r", "b"), ("s", "c")], "reply_id string, id string")
    none = spark.createDataFrame([], "reply_id string, group string, pos int, id string")
    got = placement.validate_placements(none, valid, valid.where("reply_id = 'r'").select("reply_id").distinct())[0].collect()
    assert {(r.id, r.placement) for r in got} == {("a", "side"), ("b", "side")}


def test_mark_reaches_the_scan(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    state = spark.createDataFrame([("last_run_at", "2024-01-20 00:00:00")], "key string, value string")
    cut = filters.incremental_cut(events, state, "2024-01-31", ts="ts")
    assert "GreaterThan(ts" in cut._jdf.queryExecution().executedPlan().toString()
    assert cut.count() == events.where("ts > timestamp_ntz'2024-01-20 00:00:00'").count()


@pytest.mark.parametrize("name", ["pack_chunks", "extract_timeline_pages"])
def test_workers_need_no_copy_of_the_package(tmp_path, name):
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from postmill.plans.catalog import QUERIES
from postmill.session import build_session
spark = build_session("local[2]", spark__ui__enabled="false", spark__sql__shuffle__partitions="2", spark__checkpoint__dir={str(tmp_path)!r})
print("rows", QUERIES[{name!r}](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "rows " in out.stdout, out.stderr[-2000:]


def test_messages_of_an_article_move_once_before_they_are_ranked(spark):
    keywords = spark.createDataFrame([("a", "open"), ("b", "axe")], "id string, keyword string")
    messages = spark.createDataFrame([("c", 0, "open axe"), ("c", 1, "axe")], "channel string, ordinal int, block string")
    plan = evidence.keyword_snippets(keywords, messages)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(id#\w+, channel#", plan)
