"""Engagement score of a post from its JSON metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import col

# Keys in order of precedence, and whether zero falls through to the next key.
VARIANTS = {
    "sql": (["points", "score", "upvotes", "likes", "num_comments"], False),
    "py": (["points", "score", "upvotes", "likes", "num_comments"], True),
    "cli": (["score", "points", "likes", "upvotes"], True),
}
NUMERIC = r"^-?[0-9]+(\.[0-9]+)?$"


def engagement_score(metadata: Column | str, variant: str = "sql") -> Column:
    keys, zero_falls_through = VARIANTS[variant]
    parsed = F.from_json(col(metadata), ", ".join(f"{k} STRING" for k in keys))

    def value(key: str) -> Column:
        text = parsed[key]
        number = F.when(text.rlike(NUMERIC), text.try_cast("double"))
        return F.nullif(number, F.lit(0.0)) if zero_falls_through else number

    return F.coalesce(*[value(k) for k in keys], F.lit(0.0))


def score_text(score: Column | str) -> Column:
    """Whole numbers without a fraction."""
    s = col(score)
    return F.when(s == F.floor(s), F.floor(s).cast("string")).otherwise(s.cast("string"))
