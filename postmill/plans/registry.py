"""Registered queries and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


# The bindings of the test tables, as SQL.
_CTES = {
    "posts": """posts AS (
        SELECT event_type AS source, CAST(event_id AS VARCHAR) AS source_id, CAST(NULL AS VARCHAR) AS source_url,
               CAST(user_id AS VARCHAR) AS author, props AS content, ts AS "timestamp", CAST(NULL AS VARCHAR) AS parent_id,
               CASE WHEN event_id % 6 = 5 THEN '{}' ELSE '{"' || list_extract(
                   ['points','score','upvotes','likes','num_comments'], event_id % 6 + 1)
                   || '": ' || CAST(CAST(round(value) AS BIGINT) AS VARCHAR) || '}' END AS metadata,
               ts AS fetched_at, event_id AS post_id
        FROM events)""",
    "scored": """scored AS (
        SELECT *, CAST(coalesce(json_extract_string(metadata, '$.points'), json_extract_string(metadata, '$.score'),
                   json_extract_string(metadata, '$.upvotes'), json_extract_string(metadata, '$.likes'),
                   json_extract_string(metadata, '$.num_comments'), '0') AS DOUBLE) AS score,
               CAST(coalesce(json_extract_string(metadata, '$.score'), json_extract_string(metadata, '$.points'),
                   json_extract_string(metadata, '$.likes'), json_extract_string(metadata, '$.upvotes'), '0') AS DOUBLE) AS cli_score
        FROM posts)""",
    "text_posts": """text_posts AS (
        SELECT doc_id AS post_id, source, CAST(doc_id AS VARCHAR) AS source_id, CAST(NULL AS VARCHAR) AS source_url, lang AS author, text AS content,
               TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id % 500000 * 7 AS INTEGER)) AS "timestamp"
        FROM documents)""",
    "messages": """messages AS (
        SELECT CAST(conv_id AS VARCHAR) AS channel, turn AS ordinal, role AS author, text AS content,
               '[' || role || ']' || chr(10) || text || chr(10) AS block,
               TIMESTAMP '2026-04-17' + to_minutes(CAST((conv_id * 60 + turn) % 500000 AS INTEGER)) AS ts_kst
        FROM conversations)""",
    "articles": """articles AS (
        SELECT 'art-' || CAST(doc_id AS VARCHAR) AS id, doc_id AS ord, string_split(text, chr(10))[1] AS headline, text AS body,
               CASE WHEN toxic = 0 THEN 'news' ELSE 'rumor' END AS category,
               CASE WHEN quality = 1 THEN 'high' ELSE 'low' END AS trust,
               TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id % 500000 * 7 AS INTEGER)) AS created_at,
               CASE WHEN doc_id % 7 = 0 THEN 'top' WHEN doc_id % 7 <= 2 THEN 'main' WHEN doc_id % 7 <= 5 THEN 'side' END AS placement,
               TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id % 500000 * 7 AS INTEGER)) AS placed_at, source AS origin, lang
        FROM documents LEFT JOIN labels USING (doc_id))""",
    "runs": """runs AS (
        SELECT o_orderpriority AS source, o_orderdate AS started_at,
               CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'error' ELSE 'running' END AS status,
               o_orderkey AS run_no, o_custkey AS rows_read
        FROM orders)""",
    "publog": """publog AS (
        SELECT 'art-' || CAST(doc_id AS VARCHAR) AS article_id,
               CASE WHEN quality = 1 THEN 'github_pages' ELSE 'discord' END AS platform
        FROM labels)""",
}


def given(*names: str, more: str = "", recursive: bool = False) -> str:
    """``WITH`` clause of the named bindings and further definitions."""
    parts = [_CTES[n] for n in names] + ([more] if more else [])
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


# Strings as the library trims and folds them.
SQL_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(12288)"
NON_WORD_SQL = "'[^\\p{L}\\p{N}_]+'"
TOKENS_SQL = (
    "list_sort(list_distinct(list_filter(string_split(regexp_replace(lower({0}), "
    + NON_WORD_SQL + ", ' ', 'g'), ' '), lambda w: length(w) >= 2)))"
)


def tokens_sql(column: str) -> str:
    return TOKENS_SQL.replace("{0}", column)
