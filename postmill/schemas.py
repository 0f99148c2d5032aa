"""Spark DDL of the tables the operators exchange."""

POSTS = """
    source STRING, source_id STRING, source_url STRING, author STRING, content STRING,
    timestamp TIMESTAMP, parent_id STRING, metadata STRING, fetched_at TIMESTAMP
"""

# Crawl files carry every field as text; types are applied after validation.
RAW_POSTS = """
    source STRING, source_id STRING, source_url STRING, author STRING, content STRING,
    timestamp STRING, parent_id STRING, metadata STRING, fetched_at STRING, _corrupt STRING
"""

ARTICLE = """
    id STRING, headline STRING, body STRING, category STRING, trust STRING,
    created_at TIMESTAMP, placement STRING, placed_at TIMESTAMP, merged_from ARRAY<STRING>
"""

DAILY_SUMMARY = """
    schema_version INT, title STRING, date DATE, generated_at TIMESTAMP,
    article_count BIGINT, body STRING
"""

STATE = f"""
    schema_version INT, last_run_at TIMESTAMP, generated_at TIMESTAMP, journal STRING, model STRING,
    articles ARRAY<STRUCT<{ARTICLE}>>,
    decision_log ARRAY<STRUCT<run_at: TIMESTAMP, new_count: INT, placements: MAP<STRING, STRING>>>,
    daily_summary STRUCT<{DAILY_SUMMARY}>
"""

STATE_V1 = """
    schema_version INT, generated_at STRING, period STRUCT<start: STRING, end: STRING>,
    articles ARRAY<STRUCT<id: STRING, headline: STRING, body: STRING>>
"""

INGEST_RUNS = """
    source STRING, started_at TIMESTAMP, finished_at TIMESTAMP, status STRING,
    rows_read BIGINT, rows_inserted BIGINT, rows_skipped BIGINT,
    error_message STRING, metadata STRING
"""

MESSAGES = """
    channel STRING, ordinal BIGINT, header STRING, author STRING, ts_kst TIMESTAMP_NTZ,
    content STRING, block STRING
"""

TIMELINE = """
    page_no INT, pos INT, id STRING, url STRING, user STRING, ts TIMESTAMP, replying_to STRING, content STRING,
    stats STRUCT<replies: BIGINT, retweets: BIGINT, quotes: BIGINT, likes: BIGINT, plays: BIGINT>,
    next_cursor STRING
"""
