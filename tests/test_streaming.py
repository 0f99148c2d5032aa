import json
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from postmill import schemas
from postmill.operators import filters
from postmill.sources import store
from postmill.streaming import ingest


def write(path, rows):
    path.write_text("\n".join(json.dumps(r) if isinstance(r, dict) else r for r in rows), encoding="utf-8")


def post(i, content, at):
    return {"source": "hn", "source_id": str(i), "content": content, "timestamp": "2026-04-01T00:00:00Z", "fetched_at": at, "metadata": {"points": i}}


def test_stream_ingest_keeps_each_key_once(spark, tmp_path):
    drops, path, ck, runs = tmp_path / "drops", str(tmp_path / "store"), str(tmp_path / "ck"), str(tmp_path / "runs")
    drops.mkdir()
    write(drops / "a.jsonl", [post(1, "old", "2026-04-01T01:00:00Z"), post(1, "new", "2026-04-01T02:00:00Z"), "{broken", post(2, "", "2026-04-01T01:00:00Z")])
    ingest.stream_ingest(spark, str(drops), path, ck, runs).awaitTermination()
    write(drops / "b.jsonl", [post(1, "newest", "2026-04-02T01:00:00Z"), post(3, "three", "2026-04-02T01:00:00Z")])
    for _ in range(2):
        ingest.stream_ingest(spark, str(drops), path, ck, runs).awaitTermination()
    rows = store.read_store(spark, path)
    assert {(r.source_id, r.content, r.metadata) for r in rows.collect()} == {("1", "newest", '{"points": 1}'), ("3", "three", '{"points": 3}')}
    log = spark.read.json(runs).groupBy("source").agg(F.sum("rows_read").alias("r"), F.sum("rows_inserted").alias("i"), F.sum("rows_skipped").alias("s"))
    assert {(r.source, r.r, r.i, r.s) for r in log.collect()} == {("hn", 5, 4, 1), ("unknown", 1, 0, 1)}
    assert ingest.read_runs(spark, runs).where("status = 'success'").count() == 3


def test_listener_sees_the_figures_and_the_failure(spark, tmp_path):
    drops, path, runs = tmp_path / "drops", str(tmp_path / "store"), str(tmp_path / "runs")
    drops.mkdir()
    write(drops / "a.jsonl", [post(1, "one", "2026-04-01T01:00:00Z"), "{broken", post(2, "", "2026-04-01T01:00:00Z"), post(3, "x", "soon") | {"timestamp": "soon"}])
    log = ingest.RunLog()
    spark.streams.addListener(log)
    try:
        ingest.stream_ingest(spark, str(drops), path, str(tmp_path / "ck"), runs).awaitTermination()
        (tmp_path / "broken").mkdir()
        (tmp_path / "broken/data").write_text("a file where the store has a folder")
        failing = ingest.stream_ingest(spark, str(drops), str(tmp_path / "broken"), str(tmp_path / "ck2"), str(tmp_path / "runs2"))
        with pytest.raises(StreamingQueryException):
            failing.awaitTermination()
        for _ in range(100):
            if len(log.rows) >= 2:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    seen = log.frame(spark).collect()
    assert [(r.status, r.rows_read, r.rows_inserted, r.rows_skipped) for r in seen if r.status == "success"][:1] == [("success", 4, 1, 3)]
    assert [r for r in seen if r.status == "error"]
    failed = ingest.read_runs(spark, str(tmp_path / "runs2")).collect()
    assert {(r.source, r.status, r.rows_read, r.rows_inserted) for r in failed} == {("hn", "error", 3, 0), ("unknown", "error", 1, 0)}
    assert all(r.error_message for r in failed)


def test_logged_runs(spark, tmp_path):
    store_at, runs = str(tmp_path / "store"), str(tmp_path / "runs")
    lines = [json.dumps({k: str(v) for k, v in post(i, "c" if i else "", "2026-04-01T01:00:00Z").items() if k != "metadata"}) for i in range(3)] + ["{no"]
    rows = spark.createDataFrame([(x,) for x in lines], "value string").select(F.from_json("value", schemas.RAW_POSTS, {"columnNameOfCorruptRecord": "_corrupt"}).alias("p")).select("p.*")
    assert ingest.logged_run(spark, "hn", lambda: rows, store_at, runs)
    assert not ingest.logged_run(spark, "gone", lambda: spark.read.schema(schemas.RAW_POSTS).json(str(tmp_path / "nowhere")), store_at, runs)
    got = {r.source: r for r in ingest.read_runs(spark, runs).collect()}
    assert (got["hn"].status, got["hn"].rows_read, got["hn"].rows_inserted, got["hn"].rows_skipped) == ("success", 4, 2, 2)
    assert got["gone"].status == "error" and "nowhere" in got["gone"].error_message and got["gone"].finished_at >= got["gone"].started_at
    assert store.read_store(spark, store_at).count() == 2


def test_mark_moves_even_without_rows(spark):
    state = spark.createDataFrame([("last_run_at", "2026-04-01 00:00:00")], "key string, value string").withColumn("updated_at", F.to_timestamp(F.lit("2026-04-01")))
    posts = spark.createDataFrame([(1, "2026-04-01 00:00:00"), (2, "2026-04-01 00:00:01")], "id int, timestamp string").withColumn("timestamp", F.to_timestamp("timestamp"))
    assert [r.id for r in filters.incremental_cut(posts, state, "2026-04-02").collect()] == [2]
    moved = filters.advance_mark(state, "2026-04-02 09:00:00")
    assert filters.incremental_cut(posts, moved, "2026-04-03").count() == 0
    assert filters.incremental_cut(posts, moved, "2026-04-03", override="2026-03-01").count() == 2
    assert filters.incremental_cut(posts, state.limit(0), "2026-04-03").count() == 2
