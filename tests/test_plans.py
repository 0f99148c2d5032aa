"""Physical plans: what reaches the scan, what is trimmed before a shuffle, and what must not appear."""

import re

import pytest

from postmill.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    df = QUERIES[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def test_recent_top_pushes_time_and_trims_groups(spark):
    p = plan(spark, "recent_top_by_source")
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts", p)
    assert p.count("WindowGroupLimit") == 2 and "Partial" in p


@pytest.mark.parametrize("name", ["since", "time_window", "source_counts_since", "run_failures"])
def test_time_filters_reach_the_scan(spark, name):
    assert re.search(r"PushedFilters: \[[^\]]*(GreaterThan|LessThan)[A-Za-z]*\((ts|o_orderdate)", plan(spark, name))


@pytest.mark.parametrize("name", [
    "latest_run_per_source", "upsert", "insert_ignore", "exact_title_dedup", "topic_evidence", "summary_fallback",
    "top_keywords", "validate_placements", "context_selection",
])
def test_ranked_groups_are_trimmed_on_the_map_side(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


@pytest.mark.parametrize("name", ["recent", "top_scored", "recent_titles", "bm25_search", "front_page"])
def test_limits_are_top_k(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"pipeline_state", "near_dup_dedup", "pack_chunks", "pack_chunks_tokens", "pack_one_stream", "merge_anchor"}))
def test_no_products_and_no_row_udfs(spark, name):
    p = plan(spark, name)
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert word not in p, word


def test_stats_read_two_columns(spark):
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan(spark, "source_stats")).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"ts", "event_type"}


def test_keywords_move_no_words(spark):
    moved = [line for line in plan(spark, "top_keywords").splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not any("keyword#" in line for line in moved)
