"""Incremental ingestion of crawl drops, and the log of its runs.

Every row is judged once; what the store takes, what the run row counts and what a listener sees come from that
one judgement and from the pass that reads the drop.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from postmill import schemas
from postmill.operators.validate import missing_fields, normalize_posts
from postmill.sources.jsonl import typed_posts
from postmill.sources.store import merge_into_store

METRICS = "ingest"
ORDER = ["fetched_at", "timestamp", "content", "metadata"]


def judged(raw: DataFrame) -> DataFrame:
    """Typed rows with the ``reason`` why the store does not take them, empty for those it takes.

    ``raw`` are rows as ``RAW_POSTS``; ``_corrupt`` holds a line that is no JSON object.
    """
    typed = typed_posts(raw)
    return typed.withColumn("reason", F.when(F.col("_corrupt").isNotNull(), "unreadable").otherwise(missing_fields()))


def run_counts() -> list[Column]:
    """The figures of a run over judged rows."""
    taken = F.coalesce(F.col("reason") == "", F.lit(False))
    return [
        F.count(F.lit(1)).alias("rows_read"), F.count_if(taken).alias("rows_inserted"), F.count_if(~taken).alias("rows_skipped"),
    ]


def accepted(rows: DataFrame) -> DataFrame:
    """The posts of judged rows in store form."""
    valid, _ = normalize_posts(rows.where("reason = ''").drop("_corrupt", "reason"))
    return valid


def run_rows(counts: DataFrame, started: datetime, error: str | None = None, about: dict | None = None) -> DataFrame:
    """Run rows in the form of ``INGEST_RUNS`` from (source, rows_read, rows_inserted, rows_skipped)."""
    facts = [F.lit(v).alias(k) for k, v in (about or {}).items()]
    return counts.select(
        "source", F.lit(started).cast("timestamp").alias("started_at"), F.lit(datetime.now(timezone.utc)).cast("timestamp").alias("finished_at"),
        F.lit("success" if error is None else "error").alias("status"), "rows_read",
        (F.col("rows_inserted") if error is None else F.lit(0).cast("bigint")).alias("rows_inserted"), "rows_skipped",
        F.lit(None if error is None else error[:2000]).cast("string").alias("error_message"),
        (F.to_json(F.struct(*facts)) if facts else F.lit("{}")).alias("metadata"),
    )


def stream_ingest(
    spark: SparkSession, in_dir: str, store: str, checkpoint: str, runs: str | None = None, max_files: int = 1_000
) -> StreamingQuery:
    """Validate new JSON-lines files and merge them into the store; each key is stored once.

    Replayed batches merge to the same rows, so the store is exact even when a batch runs twice. Within a batch the
    later fetch of a key wins. The progress of the query carries the run's figures under ``ingest``; with ``runs`` each batch leaves
    one run row per source, also when it fails.
    """
    stream = (
        spark.readStream.schema(schemas.RAW_POSTS).option("columnNameOfCorruptRecord", "_corrupt")
        .option("maxFilesPerTrigger", max_files).json(in_dir)
    )

    def merge(batch: DataFrame, batch_id: int) -> None:
        started, error = datetime.now(timezone.utc), None
        batch.persist()
        try:
            merge_into_store(accepted(batch), store, ORDER)
        except Exception as e:
            error = str(e)
            raise
        finally:
            if runs:
                # A folder per batch: a replay replaces its own rows.
                counts = batch.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(*run_counts())
                run_rows(counts, started, error, {"batch_id": batch_id}).write.mode("overwrite").json(f"{runs}/batch={batch_id}")
            batch.unpersist()

    watched = judged(stream).observe(METRICS, *run_counts())
    return watched.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()


class RunLog(StreamingQueryListener):
    """Run figures of every batch as the queries report them, and an error row for a query that fails."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        found = progress.observedMetrics.get(METRICS)
        if found is not None and found["rows_read"]:
            self.rows.append((str(progress.name or progress.id), progress.batchId, "success", found["rows_read"], found["rows_inserted"], found["rows_skipped"], None))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception is not None:
            self.rows.append((str(event.id), None, "error", None, None, None, event.exception[:2000]))

    def frame(self, spark: SparkSession) -> DataFrame:
        form = "source string, batch_id bigint, status string, rows_read bigint, rows_inserted bigint, rows_skipped bigint, error_message string"
        return spark.createDataFrame(self.rows, form)


def logged_run(spark: SparkSession, source: str, read: Callable[[], DataFrame], store: str, runs: str) -> bool:
    """One run of a source: a row when it starts, replaced by its outcome; an error is logged, not raised.

    ``read`` gives raw rows as ``RAW_POSTS``. Their figures are observed in the pass that merges them, which reads the
    rows once: they are written beside the store first. Returns whether the run succeeded.
    """
    started = datetime.now(timezone.utc)
    folder = f"{runs}/run={source}-{started:%Y%m%d%H%M%S%f}"
    none = spark.createDataFrame([(source, 0, 0, 0)], "source string, rows_read bigint, rows_inserted bigint, rows_skipped bigint")
    run_rows(none, started, None, {}).withColumn("status", F.lit("running")).write.mode("overwrite").json(folder)
    seen, counts, error = Observation(), none, None
    try:
        rows = f"{store}-arrived/{source}-{started:%Y%m%d%H%M%S%f}"
        judged(read()).observe(seen, *run_counts()).write.mode("overwrite").parquet(rows)
        counts = spark.createDataFrame([(source, *(seen.get[c] for c in ("rows_read", "rows_inserted", "rows_skipped")))], none.schema)
        merge_into_store(accepted(spark.read.parquet(rows)), store, ORDER)
    except Exception as e:
        error = str(e)
    run_rows(counts, started, error).write.mode("overwrite").json(folder)
    return error is None


def read_runs(spark: SparkSession, runs: str) -> DataFrame:
    """The run rows of a log, of streams and of single runs alike."""
    return spark.read.schema(schemas.INGEST_RUNS).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(runs)
