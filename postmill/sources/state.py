"""State documents, snapshots and daily exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postmill import schemas
from postmill.functions.text import blank_to_null
from postmill.functions.times import parse_iso
from postmill.operators.numbering import with_offsets
from postmill.sources.folders import names_in, put_name, remove_folder


def read_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(document fields, articles with input position, decision log) of state files; folders ``name=value`` are columns of all."""
    doc = spark.read.schema(schemas.STATE).option("multiLine", True).json(path)
    parts = doc.columns[len(StructType.fromDDL(schemas.STATE)):]
    articles = doc.select(*parts, F.posexplode("articles").alias("ord", "a")).select(*parts, F.col("ord").cast("bigint").alias("ord"), "a.*")
    log = doc.select(*parts, F.inline("decision_log"))
    return doc.drop("articles", "decision_log"), articles, log


def migrate_state_v1(doc: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(document fields, articles) in the current form from v1 documents; ``keep`` columns stay on articles."""
    keep = keep or []
    old = doc.where(F.coalesce("schema_version", F.lit(1)) != 2)
    head = old.select(
        F.lit(2).alias("schema_version"), parse_iso("period.end").alias("last_run_at"),
        parse_iso("generated_at").alias("generated_at"),
    )
    rows = old.select(*keep, "generated_at", F.posexplode("articles").alias("pos", "a"))
    made = parse_iso("generated_at")
    number = (F.col("pos") + 1).cast("string")
    default = F.concat(F.lit("legacy-"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number))
    articles = rows.select(
        *keep, F.coalesce(blank_to_null(F.col("a.id")), default).alias("id"), F.col("a.headline").alias("headline"),
        F.col("a.body").alias("body"), made.alias("created_at"), F.lit(None).cast("string").alias("placement"),
        made.alias("placed_at"),
    )
    return head, articles


def save_snapshot(df: DataFrame, path: str, version: int, keep: int | None = None) -> None:
    """Write one version beside the earlier ones and name it; a version is named once.

    Readers see named versions only, so a write that dies is no version, and is replaced when it runs again. With ``keep``
    only that many of the newest versions stay: choose it so that no read of an older one outlasts them.
    """
    spark = df.sparkSession
    if version in snapshot_versions(spark, path):
        raise ValueError(f"version {version} is already saved in {path}")
    df.write.mode("overwrite").parquet(f"{path}/version={version}")
    put_name(spark, f"{path}/_named", f"version={version}")
    for old in snapshot_versions(spark, path)[:-keep] if keep else []:
        # The name goes first: a version without it is not read.
        remove_folder(spark, f"{path}/_named/version={old}")
        remove_folder(spark, f"{path}/version={old}")


def snapshot_versions(spark: SparkSession, path: str) -> list[int]:
    """Named versions, oldest first."""
    return sorted(int(n.removeprefix("version=")) for n in names_in(spark, f"{path}/_named"))


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A named snapshot, the newest by default."""
    named = snapshot_versions(spark, path)
    wanted = version if version is not None else max(named, default=None)
    if wanted not in named:
        raise ValueError(f"no version {'' if version is None else version} in {path}".replace("  ", " "))
    return spark.read.parquet(f"{path}/version={wanted}")


def daily_documents(runs: DataFrame, summaries: DataFrame, generated_at: Column, journal: str) -> DataFrame:
    """One export header per run date, also for dates without articles.

    ``runs`` are (run_date), ``summaries`` (run_date, title, body, article_count). The articles of a date are rows
    of their own (``daily_articles``), so no document grows with its date.
    """
    return runs.select("run_date").join(summaries, "run_date").select(
        F.lit(1).alias("schema_version"), F.lit(journal).alias("journal"), F.col("run_date").alias("date"),
        generated_at.alias("generated_at"), F.col("article_count").alias("count"),
        F.struct(
            F.lit(1).alias("schema_version"), "title", F.col("run_date").alias("date"), generated_at.alias("generated_at"),
            "article_count", "body",
        ).alias("daily_summary"),
    )


def daily_articles(articles: DataFrame) -> DataFrame:
    """The articles (run_date, ord, ...) of each date with their place in its document, from 0."""
    fields = [c for c in articles.columns if c not in ("run_date", "ord")]
    placed = with_offsets(articles, ["run_date"], "ord", {"place": F.lit(1)})
    return placed.select(F.col("run_date").alias("date"), "place", *fields)


def write_daily_export(documents: DataFrame, articles: DataFrame, path: str) -> None:
    """Headers and articles by date; writing a date again replaces it."""
    for rows, part in ((documents, "documents"), (articles, "articles")):
        (
            rows.withColumn("day", F.col("date")).hint("rebalance", "day")
            .write.partitionBy("day").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(f"{path}/{part}")
        )
