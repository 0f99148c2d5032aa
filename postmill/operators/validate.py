"""Row validation and the mappings onto the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.replies import kind, let, strict_json
from postmill.functions.text import blank_to_null, col, safe_int, strip

REQUIRED = ["source", "source_id", "content", "timestamp"]


def normalize_metadata(c: Column | str) -> Column:
    """Metadata as the text of a JSON object.

    Objects stay, also when they arrive as a JSON string; null becomes ``{}`` and any other
    value ``{"value": ...}``.
    """
    text = col(c)

    def wrapped(v: Column) -> Column:
        return F.concat(F.lit('{"value":'), F.to_json(v), F.lit("}"))

    def of_text(inner: Column) -> Column:
        plain = F.to_json(F.struct(inner.alias("value")))
        parsed = lambda v: F.when(kind(v) == "object", inner).otherwise(F.coalesce(wrapped(v), plain))
        return let(strict_json(inner), parsed)

    def of_value(v: Column) -> Column:
        as_kind = lambda k: (
            F.when(k == "missing", F.to_json(F.struct(text.alias("value"))))
            .when(k == "null", F.lit("{}"))
            .when(k == "object", text)
            .when(k == "string", of_text(F.try_variant_get(v, "$", "string")))
            .otherwise(wrapped(v))
        )
        return let(kind(v), as_kind)

    return F.when(text.isNull(), F.lit("{}")).otherwise(let(strict_json(text), of_value))


def missing_fields(columns: list[str] = REQUIRED) -> Column:
    """Names of the required columns that are null or empty, comma separated."""
    checks = [F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(c)) for c in columns]
    return F.concat_ws(", ", *checks)


def normalize_posts(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into (valid, rejected); rejected rows carry the reason."""
    checked = raw.withColumn("reason", missing_fields())
    valid = (
        checked.where("reason = ''").drop("reason")
        .withColumn("metadata", normalize_metadata("metadata"))
        .withColumn("fetched_at", F.coalesce(F.col("fetched_at"), F.col("timestamp")))
    )
    return valid, checked.where("reason <> ''")


def derive_tags(df: DataFrame) -> Column:
    """Existing tags, else the non-empty ones of category, trust and placement."""
    built = F.filter(F.array("category", "trust", "placement"), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.col("tags"), built) if "tags" in df.columns else built


def articles_to_rows(
    articles: DataFrame, generated_at: Column, source: str, updated_at: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Stored article rows and the rejected articles without an id; ``source`` names articles that have none.

    ``updated_at`` is the time of the save, now by default.
    """

    def pick(*names: str) -> Column:
        found = [blank_to_null(F.col(n)) for n in names if n in articles.columns]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    def maybe(name: str) -> Column:
        return F.col(name) if name in articles.columns else F.lit(None).cast("string")

    times = [F.col(n) for n in ("created_at", "placed_at") if n in articles.columns]
    created = F.coalesce(*times, generated_at)
    clean_id = strip(F.coalesce(F.col("id"), F.lit("")))
    rows = articles.where(clean_id != "").select(
        clean_id.alias("id"),
        F.coalesce(maybe("source"), F.lit(source)).alias("source"),
        strip(F.coalesce(pick("headline", "title"), F.lit(""))).alias("title"),
        pick("url", "source_url").alias("url"),
        safe_int(maybe("score")).alias("score"),
        safe_int(maybe("comments")).alias("comments"),
        maybe("summary").alias("summary"),
        F.col("body"),
        derive_tags(articles).alias("tags"),
        F.to_json(F.struct(*articles.columns)).alias("raw_json"),
        created.alias("crawled_at"),
        created.alias("created_at"),
        "placement", "placed_at", "category", "trust",
        generated_at.alias("generated_at"),
        (F.current_timestamp() if updated_at is None else updated_at).alias("updated_at"),
    )
    return rows, articles.where(clean_id == "")
