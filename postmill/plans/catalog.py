"""All registered queries."""

from postmill.plans import article_queries, chat_queries, ingest_queries, post_queries  # noqa: F401
from postmill.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
