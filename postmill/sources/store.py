"""The keyed post store: Parquet by source and day, in versions.

A merge writes the days it touches as a new version and then, in one small file, the list that says which
version of each day holds. Until that file is there the old list holds, so a merge that dies loses nothing and
runs again. Rows of a day are sorted by time; a read of recent days opens their files alone.
"""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postmill import schemas
from postmill.operators.merges import POST_KEYS, insert_ignore, upsert
from postmill.operators.validate import normalize_metadata
from postmill.sources.folders import has_folder, remove_folder
from postmill.sources.key_filter import key_filters, probable_places

PARTS = ["source", "dt"]
DAYS = "source STRING, dt DATE, data_version BIGINT"


def _days(spark: SparkSession, path: str) -> tuple[DataFrame | None, int]:
    """The days that hold, with the version of each, and the number of the last merge; none without a store."""
    try:
        lists = spark.read.schema(f"{DAYS}, merge BIGINT").parquet(f"{path}/days")
        last = lists.agg(F.max("merge")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None, 0
    return (None, 0) if last is None else (lists.where(F.col("merge") == last).drop("merge"), last)


def _stored(spark: SparkSession, path: str, schema: StructType, days: DataFrame) -> DataFrame:
    """Rows of the listed days of their versions."""
    plain = StructType([f for f in schema.fields if f.name not in PARTS])
    full = plain.add("data_version", "long").add("source", "string").add("dt", "date")
    # Versions that hold no day are not even listed.
    live = sorted(r["data_version"] for r in days.select("data_version").distinct().collect())
    folders = [f"{path}/data/data_version={v}" for v in live]
    if not folders:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", f"{path}/data").parquet(*folders)


def read_store(spark: SparkSession, path: str, schema: StructType | None = None, since: date | str | None = None) -> DataFrame:
    """The stored rows, of the days from ``since`` on if it is given.

    ``schema`` has the columns without ``dt``; it is given because folder names would be guessed as numbers.
    The list of days, one row per source and day, is broadcast and prunes the folders.
    """
    wanted = schema or StructType.fromDDL(schemas.POSTS)
    days, _ = _days(spark, path)
    if days is None:
        return spark.createDataFrame([], wanted).withColumn("dt", F.lit(None).cast("date"))
    if since is not None:
        days = days.where(F.col("dt") >= F.lit(str(since)).cast("date"))
    rows = _stored(spark, path, wanted, days)
    if since is not None:
        rows = rows.where(F.col("dt") >= F.lit(str(since)).cast("date"))
    return rows.join(F.broadcast(days), [*PARTS, "data_version"]).select(*[f.name for f in wanted.fields], "dt")


FEW_DAYS = 2_000


def _opened(spark: SparkSession, path: str, schema: StructType, days: DataFrame, chosen: list) -> DataFrame:
    """Stored rows of the chosen ``(source, dt)``: their folders alone are opened."""
    picked = spark.createDataFrame([(r["source"], r["dt"]) for r in chosen], "source string, dt date")
    rows = _stored(spark, path, schema, days.join(F.broadcast(picked), PARTS, "left_semi"))
    if len(chosen) <= FEW_DAYS:
        # Literals prune folders while the scan is planned; beyond them the join below does it as it runs.
        for part in PARTS:
            rows = rows.where(F.col(part).isin(sorted({r[part] for r in chosen if r[part] is not None})))
    # One row per source and day.
    live = F.broadcast(days.join(F.broadcast(picked), PARTS, "left_semi"))
    return rows.join(live, [*PARTS, "data_version"], "left_semi").select(*[f.name for f in schema.fields], "dt")


def stored_places(spark: SparkSession, path: str, batch: DataFrame, keys: list[str], schema: StructType) -> list:
    """The ``(source, dt)`` that hold keys of the batch, by the filters first and by the keys of the passing days then."""
    days, _ = _days(spark, path)
    if days is None:
        return []
    versions = sorted(r["data_version"] for r in days.select("data_version").distinct().collect())
    folders = [f for f in (f"{path}/keys/data_version={v}" for v in versions) if has_folder(spark, f)]
    form = "source string, dt date, level int, block bigint, bits binary, keyed string, data_version bigint"
    filters = spark.read.schema(form).option("basePath", f"{path}/keys").parquet(*folders) if folders else spark.createDataFrame([], form)
    live = filters.where(F.col("keyed") == ",".join(keys)).join(F.broadcast(days), [*PARTS, "data_version"], "left_semi")
    probable = probable_places(live.select(*PARTS, "level", "block", "bits"), batch, keys, PARTS).select(*keys, *[p for p in PARTS if p not in keys])
    # Days written without a filter of these keys are opened.
    unknown = days.select(*PARTS).join(live.select(*PARTS).distinct(), PARTS, "left_anti").collect()
    passing = probable.select(*PARTS).distinct().collect()
    if not passing and not unknown:
        return []
    rows = _opened(spark, path, schema, days, passing + unknown)
    return rows.select(*keys, *[p for p in PARTS if p not in keys]).join(batch.select(*keys).distinct(), keys, "left_semi").select(*PARTS).distinct().collect()


def merge_into_store(
    incoming: DataFrame, path: str, order: list[str], keys: list[str] = POST_KEYS, first_wins: bool = False, day: str = "timestamp",
) -> None:
    """Merge a batch into the store; running the same batch again changes nothing.

    Rewritten are the days of the batch and, as a key may move, the days that hold its keys. The key filters tell which
    days can; only those are opened, so a batch of new keys reads no other day than its own.
    """
    spark = incoming.sparkSession
    batch = incoming.withColumn("dt", F.to_date(day))
    merge = insert_ignore if first_wins else upsert
    days, last = _days(spark, path)
    version = last + 1
    if days is None:
        kept, merged = None, merge(batch.limit(0), batch, keys, order)
    else:
        # Touched days: one row per source and day of the batch.
        touched = {(r["source"], r["dt"]): r for r in batch.select(*PARTS).distinct().collect() + stored_places(spark, path, batch, keys, incoming.schema)}
        held = _opened(spark, path, incoming.schema, days, list(touched.values()))
        merged = merge(held, batch, keys, order)
        kept = days.join(F.broadcast(spark.createDataFrame(list(touched) or [], "source string, dt date")), PARTS, "left_anti")
    target = f"{path}/data/data_version={version}"
    merged.hint("rebalance", *PARTS).sortWithinPartitions(*PARTS, day).write.mode("overwrite").partitionBy(*PARTS).parquet(target)
    full = StructType([f for f in incoming.schema.fields if f.name not in PARTS]).add("source", "string").add("dt", "date")
    done = spark.read.schema(full).parquet(target)
    key_filters(done, keys, PARTS).withColumn("keyed", F.lit(",".join(keys))).sortWithinPartitions("source", "level", "block").write.mode("overwrite").parquet(
        f"{path}/keys/data_version={version}"
    )
    written = done.select(*PARTS).distinct().select("source", "dt", F.lit(version).cast("bigint").alias("data_version"))
    listed = written if kept is None else kept.unionByName(written)
    # The single file of this list makes the merge count.
    listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/days/merge={version}")


def old_versions(spark: SparkSession, path: str) -> list[str]:
    """Folders of versions that no day holds any more."""
    days, last = _days(spark, path)
    live = {r["data_version"] for r in days.select("data_version").distinct().collect()} if days is not None else set()
    return [f"{path}/data/data_version={v}" for v in range(1, last + 1) if v not in live and has_folder(spark, f"{path}/data/data_version={v}")]


def remove_old_versions(spark: SparkSession, path: str, keep_merges: int = 2) -> list[str]:
    """Delete what no reader of the last ``keep_merges`` lists of days can hold; returns the removed folders.

    Readers that opened an older list may fail, so keep as many merges as a read can last.
    """
    _, last = _days(spark, path)
    if not last:
        return []
    lists = spark.read.schema(f"{DAYS}, merge BIGINT").parquet(f"{path}/days")
    oldest = last - max(1, keep_merges) + 1
    held = {r["data_version"] for r in lists.where(F.col("merge") >= oldest).select("data_version").distinct().collect()}
    dead = [f"{path}/days/merge={m}" for m in range(1, oldest)]
    dead += [f"{path}/{kind}/data_version={v}" for kind in ("data", "keys") for v in range(1, last + 1) if v not in held]
    return [folder for folder in dead if remove_folder(spark, folder)]


def backfill_posts(old: DataFrame) -> DataFrame:
    """Rows of an existing posts table in store form: metadata normalised, fetch time filled."""
    return old.select(
        "source", F.col("source_id").cast("string").alias("source_id"), "source_url", "author", "content", "timestamp",
        "parent_id", normalize_metadata(F.when(F.col("metadata") != "", F.col("metadata"))).alias("metadata"),
        F.coalesce("fetched_at", "timestamp").alias("fetched_at"),
    )


def backfill_dry_run(old: DataFrame) -> DataFrame:
    """What a backfill would copy."""
    return old.agg(F.count(F.lit(1)).alias("n"))


def read_jdbc_posts(spark: SparkSession, url: str, lower: int, upper: int, partitions: int, table: str = "posts") -> DataFrame:
    """An existing posts table over JDBC, read in parallel ranges of its id."""
    return (
        spark.read.format("jdbc").option("url", url).option("dbtable", table).option("partitionColumn", "id")
        .option("lowerBound", lower).option("upperBound", upper).option("numPartitions", partitions).load()
    )
