"""Trust and follow-up rules on articles."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill import rules
from postmill.functions.text import starts_with_any, strip

# Case-insensitive, with Unicode word boundaries: a Hangul letter is a word character.
FLAGS = "(?iU)"


@dataclass(frozen=True)
class ClaimRules:
    """Patterns and texts of the unsourced-claim rule."""

    name: str = rules.MODEL_NAME
    verb: str = rules.LAUNCH_VERB
    source: str = rules.OFFICIAL_SOURCE
    soften_headline: list[tuple[str, str]] = field(default_factory=lambda: rules.SOFTEN_HEADLINE)
    soften_body: list[tuple[str, str]] = field(default_factory=lambda: rules.SOFTEN_BODY)
    headline_marks: list[str] = field(default_factory=lambda: rules.UNCONFIRMED_MARKS)
    headline_prefix: str = rules.UNCONFIRMED_PREFIX
    body_prefix: str = rules.UNCONFIRMED_BODY_PREFIX


@dataclass(frozen=True)
class StoryRules:
    """Products whose release is told once, and what makes a follow-up."""

    products: dict[str, str] = field(default_factory=lambda: rules.PRODUCT_STORIES)
    verb: str = rules.LAUNCH_VERB
    followup: str = rules.PRODUCT_FOLLOWUP
    prefix: str = rules.FOLLOWUP_PREFIX


def is_weak(category: Column | str = "category", trust: Column | str = "trust") -> Column:
    """Low-trust rumour; a missing tag is not weak."""
    c = F.col(category) if isinstance(category, str) else category
    t = F.col(trust) if isinstance(trust, str) else trust
    return F.coalesce((c == "rumor") & (t == "low"), F.lit(False))


def article_text() -> Column:
    return F.concat(F.coalesce("headline", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit("")))


def with_prefix(text: Column, prefix: str, marks: list[str]) -> Column:
    return F.when(starts_with_any(text, marks), text).otherwise(F.concat(F.lit(prefix), text))


def downgrade_unsourced_claims(articles: DataFrame, r: ClaimRules = ClaimRules()) -> DataFrame:
    """Launch claims without an official source become softened low-trust rumours."""
    headline = strip(F.coalesce("headline", F.lit("")))
    body = strip(F.coalesce("body", F.lit("")))
    text = F.concat(headline, F.lit("\n"), body)
    claim = text.rlike(FLAGS + r.name) & text.rlike(FLAGS + r.verb) & ~text.rlike(FLAGS + r.source)

    def soften(c: Column, steps: list[tuple[str, str]]) -> Column:
        return reduce(lambda acc, step: F.regexp_replace(acc, "(?U)" + step[0], step[1]), steps, c)

    new_headline = with_prefix(soften(headline, r.soften_headline), r.headline_prefix, r.headline_marks)
    new_body = with_prefix(soften(body, r.soften_body), r.body_prefix, [r.body_prefix])
    return articles.withColumn("__claim", claim).withColumns({
        "headline": F.when(F.col("__claim"), new_headline).otherwise(F.col("headline")),
        "body": F.when(F.col("__claim"), new_body).otherwise(F.col("body")),
        "category": F.when(F.col("__claim"), F.lit("rumor")).otherwise(F.col("category")),
        "trust": F.when(F.col("__claim"), F.lit("low")).otherwise(F.col("trust")),
    }).drop("__claim")


def product_story_guard(new: DataFrame, existing: DataFrame, r: StoryRules = StoryRules()) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) new articles: repeated releases go, other stories of the product are follow-ups.

    Which products are already covered is one row of flags from one pass over ``existing``.
    """
    text = article_text()
    releases = existing.where(~is_weak() & text.rlike(FLAGS + r.verb))

    patterns = [FLAGS + p for p in r.products.values()]
    flags = releases.agg(F.array(*[F.coalesce(F.bool_or(text.rlike(p)), F.lit(False)) for p in patterns]).alias("f")).scalar()
    known = reduce(
        lambda a, b: a | b, [text.rlike(p) & F.get(flags, F.lit(i)) for i, p in enumerate(patterns)], F.lit(False)
    )
    judged = new.withColumn("__known", known)
    repeat = F.col("__known") & text.rlike(FLAGS + r.verb) & ~text.rlike(FLAGS + r.followup)
    labelled = with_prefix(F.coalesce("headline", F.lit("")), r.prefix, [r.prefix])
    kept = judged.where(~repeat).withColumn(
        "headline", F.when(F.col("__known"), labelled).otherwise(F.col("headline"))
    )
    return kept.drop("__known"), judged.where(repeat).select("id")
