import hashlib
import json
import shutil

import pytest
from pyspark.sql import functions as F

from postmill import rules
from postmill.operators import validate
from postmill.sources import chat_export, jsonl, key_filter, payloads, state, store, timeline

SEP = "=" * 62
HEAD = f"{SEP}\nGuild: Dev\nChannel: a / b\nAfter: x\n{SEP}\n\n\n"


def chat_text(messages):
    return "\n\n\n".join(messages) + "\n"


MSGS = [
    "[2026. 4. 17. 오전 12:05] ann\nhello\n[not a header] more",
    "[2026. 4. 17. 오후 12:05] bob\n{Embed}\nhttps://cdn.discordapp.com/attachments/1/2/x.png",
    "[2026. 4. 17. 오후 1:30] ann\nsee https://media.discordapp.net/attachments/1/y.png now\n\n[2025] list",
]


@pytest.mark.parametrize("block_bytes", [None, 64])
@pytest.mark.parametrize("head,tail", [(HEAD, ""), ("", ""), (HEAD, f"{SEP}\n[2026. 4. 18. 오전 1:00] eve\nafter the body\n")])
def test_read_chat_export(spark, tmp_path, head, tail, block_bytes):
    (tmp_path / "a.txt").write_text(head + chat_text(MSGS) + tail, encoding="utf-8")
    if block_bytes:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block_bytes))
    try:
        rows = chat_export.read_chat_export(spark, str(tmp_path)).orderBy("ordinal").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    rows = [r for r in rows if r.ordinal >= 0]
    assert [r.author for r in rows] == ["ann", "bob", "ann"]
    assert rows[0].content == "hello\n[not a header] more"
    assert [r.ts_kst.hour for r in rows] == [0, 12, 13]
    assert "".join(r.block for r in rows).rstrip() == chat_text(MSGS).rstrip()


def test_chat_posts_have_hashed_id_and_utc(spark, tmp_path):
    (tmp_path / "a.txt").write_text(HEAD + chat_text(MSGS), encoding="utf-8")
    rows = chat_export.read_chat_export(spark, str(tmp_path))
    posts = chat_export.normalize_chat(rows, {"guild": "Dev"}, F.current_timestamp()).orderBy("timestamp").collect()
    want = hashlib.sha1("2026-04-17T00:05:00+09:00|ann|hello\n[not a header] more".encode()).hexdigest()[:16]
    assert posts[0].source_id == want
    assert str(posts[0].timestamp) == "2026-04-16 15:05:00"
    assert json.loads(posts[0].metadata) == {"guild": "Dev"}


def test_clean_message_blocks(spark):
    body = chat_text(MSGS) + "\n\n\nno header\nx\n\n\n\n[2026. 4. 17. 오후 2:00] z\n{Stickers}\n"
    df = spark.createDataFrame([("f", body)], "file string, body string")
    got = [r.block for r in chat_export.clean_message_blocks(df).orderBy("pos").collect()]
    assert got == [MSGS[0], "[2026. 4. 17. 오후 1:30] ann\nsee  now\n[2025] list"]


def test_jsonl_reader_and_validation(spark, tmp_path):
    lines = [
        json.dumps({"source": "hn", "source_id": 1, "content": "a", "timestamp": "2026-04-01T10:00:00-04:00", "metadata": {"points": 3}}),
        "", "   ", "{broken",
        json.dumps({"source": "hn", "source_id": "2", "content": "", "timestamp": "2026-04-01T10:00:00Z"}),
        json.dumps({"source": "hn", "source_id": "3", "content": "b", "timestamp": "2026-04-01T10:00:00Z", "metadata": [1], "fetched_at": "2026-04-02T00:00:00+09:00"}),
        json.dumps({"source": "hn", "source_id": "4", "content": "b", "timestamp": "soon"}),
    ]
    (tmp_path / "p.jsonl").write_text("\n".join(lines), encoding="utf-8")
    rows, bad = jsonl.read_posts_jsonl(spark, str(tmp_path))
    assert [r.value for r in bad.collect()] == ["{broken"]
    valid, rejected = validate.normalize_posts(jsonl.typed_posts(rows))
    got = {r.source_id: r for r in valid.collect()}
    assert set(got) == {"1", "3"}
    assert json.loads(got["1"].metadata) == {"points": 3} and str(got["1"].fetched_at) == "2026-04-01 14:00:00"
    assert json.loads(got["3"].metadata) == {"value": [1]} and str(got["3"].fetched_at) == "2026-04-01 15:00:00"
    assert {(r.source_id, r.reason) for r in rejected.collect()} == {("2", "content"), ("4", "timestamp")}


@pytest.mark.parametrize("raw,want", [
    (None, {}), ('{"a":1}', {"a": 1}), ('"{\\"a\\":1}"', {"a": 1}), ("plain", {"value": "plain"}), ("[1,2]", {"value": [1, 2]}),
    ("7", {"value": 7}), ("null", {}), ('"x"', {"value": "x"}), ('"[1]"', {"value": [1]}), ('{"a":1} x', {"value": '{"a":1} x'}),
])
def test_metadata_forms(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "m string").select(validate.normalize_metadata("m").alias("m"))
    assert json.loads(df.first().m) == want


def test_write_posts_layout(spark, tmp_path):
    df = spark.createDataFrame([("hn", "1", "a", "2026-04-01 20:00:00")], "source string, source_id string, content string, timestamp string")
    jsonl.write_posts(df.withColumn("timestamp", F.to_timestamp("timestamp")), str(tmp_path / "out"))
    assert (tmp_path / "out" / "source=hn" / "dt=2026-04-02").is_dir()


def test_state_round_trip_and_snapshots(spark, tmp_path):
    doc = {"schema_version": 2, "last_run_at": "2026-04-20T08:00:00+09:00", "journal": "j",
           "articles": [{"id": "a1", "headline": "h", "body": "b", "merged_from": ["x"]}, {"id": "a2", "headline": "h2", "body": "b2"}],
           "decision_log": [{"run_at": "2026-04-20T08:00:00+09:00", "new_count": 2, "placements": {"a1": "top", "a2": "side"}}]}
    (tmp_path / "state.json").write_text(json.dumps(doc, indent=2), encoding="utf-8")
    head, articles, log = state.read_state(spark, str(tmp_path / "state.json"))
    assert str(head.first().last_run_at) == "2026-04-19 23:00:00"
    assert [(r.ord, r.id) for r in articles.orderBy("ord").collect()] == [(0, "a1"), (1, "a2")]
    assert log.first().placements == {"a1": "top", "a2": "side"}
    path = str(tmp_path / "snap")
    state.save_snapshot(articles, path, 1)
    state.save_snapshot(articles.where("id = 'a1'"), path, 2)
    assert state.read_snapshot(spark, path).count() == 1 and state.read_snapshot(spark, path, 1).count() == 2


def test_daily_export_of_any_size_and_replace(spark, tmp_path):
    runs = spark.createDataFrame([("2026-04-20",), ("2026-04-21",)], "d string").select(F.to_date("d").alias("run_date"))
    arts = spark.range(1001).select(F.to_date(F.lit("2026-04-20")).alias("run_date"), (F.col("id") * 7).alias("ord"), F.concat(F.lit("a"), F.col("id")).alias("id"))
    summaries = runs.select("run_date", F.lit("t").alias("title"), F.lit("b").alias("body"), F.lit(5).cast("bigint").alias("article_count"))
    docs = state.daily_documents(runs, summaries, F.to_timestamp(F.lit("2026-04-20")), "Mill")
    rows = state.daily_articles(arts)
    assert docs.count() == 2
    assert [(r.place, r.id) for r in rows.orderBy("place").collect()] == [(i, f"a{i}") for i in range(1001)]
    for _ in range(2):
        state.write_daily_export(docs, rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/documents")).count() == 2 and spark.read.json(str(tmp_path / "out/articles")).count() == 1001


def test_v1_times_without_zone_are_kst(spark):
    doc = spark.createDataFrame([(1, ("2026-04-08 00:00", "2026-04-09 23:59"), "2026-04-10T01:00:00Z", [("x", "h", "b")])],
        "schema_version int, period struct<start: string, end: string>, generated_at string, articles array<struct<id: string, headline: string, body: string>>")
    head, _ = state.migrate_state_v1(doc)
    assert str(head.first().last_run_at) == "2026-04-09 14:59:00"


def test_snapshots_are_named_when_whole(spark, tmp_path):
    path, df = str(tmp_path / "snap"), spark.range(5)
    with pytest.raises(ValueError):
        state.read_snapshot(spark, path)
    state.save_snapshot(df, path, 1)
    # A write that died left files but no name.
    spark.range(3).write.parquet(f"{path}/version=2")
    assert state.read_snapshot(spark, path).count() == 5
    state.save_snapshot(spark.range(7), path, 2)
    with pytest.raises(ValueError):
        state.save_snapshot(df, path, 2)
    for version in range(3, 6):
        state.save_snapshot(spark.range(version), path, version, keep=2)
    assert state.snapshot_versions(spark, path) == [4, 5] and state.read_snapshot(spark, path).count() == 5 and state.read_snapshot(spark, path, 4).count() == 4
    assert sorted(p.name for p in (tmp_path / "snap").glob("version=*")) == ["version=4", "version=5"]


POST = "source string, source_id string, content string, fetched_at timestamp"


def _posts(spark, rows):
    return spark.createDataFrame(rows, "source string, source_id string, content string, day string, n int").select(
        "source", "source_id", "content", F.to_timestamp("day").alias("timestamp"), F.timestamp_seconds("n").alias("fetched_at"))


def test_store_merge_is_keyed_and_repeatable(spark, tmp_path):
    first = _posts(spark, [("7", "a", "v1", "2026-04-01", 1), ("7", "a", "v2", "2026-04-01", 2), ("y", "b", "w", "2026-04-02", 1)])
    second = _posts(spark, [("7", "a", "v3", "2026-04-03", 3), ("7", "c", "z", "2026-04-03", 3)])
    for first_wins, want in ((False, {("7", "a", "v3"), ("7", "c", "z"), ("y", "b", "w")}), (True, {("7", "a", "v1"), ("7", "c", "z"), ("y", "b", "w")})):
        path = str(tmp_path / f"store{first_wins}")
        assert store.read_store(spark, path, first.schema).count() == 0
        store.merge_into_store(first, path, ["fetched_at"], first_wins=first_wins)
        for _ in range(2):
            store.merge_into_store(second, path, ["fetched_at"], first_wins=first_wins)
        rows = store.read_store(spark, path, first.schema)
        assert {(r.source, r.source_id, r.content) for r in rows.collect()} == want


def test_store_rewrites_one_day_and_prunes(spark, tmp_path):
    path = str(tmp_path / "store")
    store.merge_into_store(_posts(spark, [("s", str(i), "x", f"2026-04-{i:02d}", 1) for i in range(1, 8)]), path, ["fetched_at"])
    store.merge_into_store(_posts(spark, [("s", "new", "y", "2026-04-05", 2)]), path, ["fetched_at"])
    assert [p.name for p in (tmp_path / "store/data/data_version=2/source=s").iterdir() if p.is_dir()] == ["dt=2026-04-05"]
    rows = store.read_store(spark, path, _posts(spark, []).schema, since="2026-04-05")
    assert {r.source_id for r in rows.collect()} == {"5", "new", "6", "7"}
    assert "dt" in rows._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    # A merge that died after writing data, before the list of days, has not happened; the next one takes its place.
    _posts(spark, [("s", "1", "half", "2026-04-01", 9)]).withColumn("source", F.lit("s")).withColumn("dt", F.to_date("timestamp")).write.partitionBy(
        "source", "dt").parquet(path + "/data/data_version=3")
    assert {r.content for r in store.read_store(spark, path, _posts(spark, []).schema).collect()} == {"x", "y"}
    store.merge_into_store(_posts(spark, [("s", "8", "z", "2026-04-08", 3)]), path, ["fetched_at"])
    assert store.read_store(spark, path, _posts(spark, []).schema).count() == 9
    assert store.old_versions(spark, path) == []


def test_new_keys_open_no_old_day(spark, tmp_path):
    path, schema = str(tmp_path / "store"), _posts(spark, []).schema
    store.merge_into_store(_posts(spark, [("s", str(i), "x", f"2026-04-{i % 9 + 1:02d}", 1) for i in range(300)]), path, ["fetched_at"])
    for file in (tmp_path / "store/data/data_version=1").rglob("*.parquet"):
        file.rename(file.with_suffix(".away"))
        file.write_bytes(b"no parquet")
        for crc in file.parent.glob(".*.crc"):
            crc.unlink()
    # Every old file is unreadable, so the merge fails if it opens one.
    store.merge_into_store(_posts(spark, [("s", f"n{i}", "y", "2026-04-20", 2) for i in range(200)] + [("t", "1", "y", "2026-04-01", 2)]), path, ["fetched_at"])
    for file in (tmp_path / "store/data/data_version=1").rglob("*.away"):
        file.rename(file.with_suffix(".parquet"))
    assert store.read_store(spark, path, schema).count() == 501
    # A known key opens its day, moves and leaves it.
    store.merge_into_store(_posts(spark, [("s", "7", "moved", "2026-04-20", 3)]), path, ["fetched_at"])
    rows = store.read_store(spark, path, schema)
    assert [(r.content, str(r.dt)) for r in rows.where("source_id = '7'").collect()] == [("moved", "2026-04-20")] and rows.count() == 501
    assert {p.name for p in (tmp_path / "store/data/data_version=3/source=s").iterdir() if p.is_dir()} <= {"dt=2026-04-08", "dt=2026-04-20"}


def test_filters_find_every_stored_key(spark):
    stored = spark.range(40_000).select(F.lit("s").alias("source"), F.col("id").cast("string").alias("source_id"), F.date_add(F.lit("2026-01-01"), (F.col("id") % 3).cast("int")).alias("dt"))
    stored = stored.where("dt < '2026-01-03' OR source_id < '2'")
    filters = key_filter.key_filters(stored, ["source", "source_id"], ["source", "dt"]).cache()
    assert filters.groupBy("dt").agg(F.max("level").alias("l"), F.count("*").alias("n")).orderBy("dt").collect()[0]["l"] == 4
    found = key_filter.probable_places(filters, stored, ["source", "source_id"], ["source", "dt"])
    assert found.join(stored, ["source", "source_id", "dt"]).count() == stored.count() and found.count() <= stored.count() + 2
    new = spark.range(40_000, 80_000).select(F.lit("s").alias("source"), F.col("id").cast("string").alias("source_id"))
    assert key_filter.probable_places(filters, new, ["source", "source_id"], ["source", "dt"]).count() <= 2
    assert key_filter.probable_places(filters, new.withColumn("source", F.lit("t")), ["source", "source_id"], ["source", "dt"]).count() == 0


def test_store_without_filters_is_read_in_full(spark, tmp_path):
    path = str(tmp_path / "store")
    store.merge_into_store(_posts(spark, [("s", "1", "x", "2026-04-01", 1), ("t", "1", "x", "2026-04-02", 1)]), path, ["fetched_at"])
    shutil.rmtree(tmp_path / "store/keys")
    store.merge_into_store(_posts(spark, [("s", "1", "y", "2026-04-03", 2)]), path, ["fetched_at"])
    assert {(r.source, r.content) for r in store.read_store(spark, path, _posts(spark, []).schema).collect()} == {("s", "y"), ("t", "x")}


def test_old_versions_go_and_the_folder_stays_bounded(spark, tmp_path):
    path, schema = str(tmp_path / "store"), _posts(spark, []).schema
    for n in range(1, 5):
        store.merge_into_store(_posts(spark, [("s", "1", f"v{n}", "2026-04-01", n), ("s", f"k{n}", "x", f"2026-05-{n:02d}", n)]), path, ["fetched_at"])
        reader = store.read_store(spark, path, schema)
        store.remove_old_versions(spark, path, keep_merges=2)
        assert reader.where("source_id = '1'").first().content == f"v{n}"
    assert reader.count() == 5 and store.remove_old_versions(spark, path, keep_merges=2) == []
    assert len(list((tmp_path / "store/days").glob("merge=*"))) == 2
    assert store.old_versions(spark, path) == []


PAGE = """<html><div class="timeline">
<div class="timeline-item"><a class="tweet-link" href="/u/status/11#m"></a><div class="tweet-body">
<span class="tweet-date"><a href="/x" title="Oct 21, 2025 · 4:34 PM UTC">1h</a></span><div class="replying-to">Replying to <a>@z</a></div>
<div class="tweet-content media-body">Hi &amp; <a>bye</a></div><div class="tweet-stats">
<span class="tweet-stat"><div class="icon-container"><span class="icon-comment"></span> 1,234</div></span>
<span class="tweet-stat"><div class="icon-container"><span class="icon-heart"></span> 1,234</div></span>
<span class="tweet-stat"><div class="icon-container"><span class="icon-play"></span></div></span></div></div></div>
<div class="timeline-item"><div class="tweet-body"><span class="tweet-date"><a title="">x</a></span></div></div>
<div class="timeline-item"><div class="tweet-body"><span class="tweet-date"><a title="Oct 1, 2025 · 12:00 AM UTC">x</a></span></div></div>
</div><div class="show-more"><a href="?cursor=abc%3D">more</a></div></html>"""


def test_timeline_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE)], "page_no int, user string, html string")
    a, b = timeline.extract_timeline_pages(df).orderBy("pos").collect()
    assert (a.id, a.url, str(a.ts), a.replying_to, a.content) == ("11", "https://nitter.net/u/status/11#m", "2025-10-21 16:34:00", "@z", "Hi & bye")
    assert a.stats.asDict() == {"replies": 0, "retweets": 0, "quotes": 0, "likes": 1234, "plays": 0}
    assert (b.id, b.url, b.ts.hour, b.next_cursor) == (None, None, 0, "abc=")


def test_timeline_with_stray_end_tags(spark):
    html = PAGE.replace('<div class="timeline-item"><div class="tweet-body"><span class="tweet-date"><a title="Oct 1', '</p></span><div class="timeline-item"><div class="tweet-body"><span class="tweet-date"><a title="Oct 1')
    df = spark.createDataFrame([(3_000_000_000, "u", html), (2, "u", None)], "page_no bigint, user string, html string")
    rows = timeline.extract_timeline_pages(df).orderBy("pos").collect()
    assert [r.content for r in rows] == ["Hi & bye", ""] and rows[0].page_no == 3_000_000_000


def test_payload_edge_cases(spark):
    def raw(payload, **extra):
        names = ", ".join(f"{k} string" for k in extra)
        df = spark.createDataFrame([(payload, *extra.values())], "payload string" + (", " + names if names else ""))
        return df.withColumn("fetched_at", F.to_timestamp(F.lit("2026-04-20 00:00:00")))

    hits = {"hits": [{"objectID": "1", "title": "New LLM", "story_text": None, "created_at_i": 0, "points": None},
                     {"objectID": "2", "title": "Gardening", "created_at_i": 0}]}
    rows = payloads.normalize_hackernews(raw(json.dumps(hits))).collect()
    assert [(r.source_id, r.content) for r in rows] == [("1", "New LLM")]
    assert json.loads(rows[0].metadata) == {"title": "New LLM", "external_url": None, "points": 0, "num_comments": 0}
    models = [{"id": "org/m", "lastModified": "bad", "tags": ["a", "b"]}, {"modelId": None, "id": ""}, {"id": "solo"}]
    rows = {r.source_id: r for r in payloads.normalize_hf_models(raw(json.dumps(models))).collect()}
    assert rows["model:org/m"].author == "org" and rows["model:solo"].author is None
    assert str(rows["model:org/m"].timestamp) == "2026-04-20 00:00:00"
    papers = [{"paper": {"id": str(i), "title": "t"}, "publishedAt": "2026-04-01T00:00:00.000Z"} for i in range(40)]
    assert payloads.normalize_hf_papers(raw(json.dumps(papers))).count() == 30
    rss = "<rss><channel><item><title> T </title><description>&lt;p&gt;D&lt;/p&gt;</description><link>http://l</link><pubDate>Mon, 06 Apr 2026 00:00:00 -0400</pubDate></item></channel></rss>"
    row = payloads.normalize_arxiv(raw(rss, category="cs.AI")).first()
    assert (row.source_id, row.content, str(row.timestamp)) == ("http://l", "T\n\nD", "2026-04-06 04:00:00")
    assert rules.HACKERNEWS_KEYWORDS[0] == "GPT"


def test_backfill_over_jdbc(spark):
    url = "jdbc:derby:memory:backfill;create=true"
    rows = [(None if i == 7 else i, "hn", str(i), f"c{i}", None if i % 3 else '"{\\"points\\": 1}"') for i in range(40)]
    old = spark.createDataFrame(rows, "id bigint, source string, source_id string, content string, metadata string").selectExpr(
        "id", "source", "source_id", "CAST(NULL AS STRING) AS source_url", "CAST(NULL AS STRING) AS author", "content", "TIMESTAMP '2026-04-01 00:00:00' AS timestamp",
        "CAST(NULL AS STRING) AS parent_id", "metadata", "CAST(NULL AS TIMESTAMP) AS fetched_at")
    old.write.format("jdbc").option("url", url).option("dbtable", "posts").option("driver", "org.apache.derby.jdbc.EmbeddedDriver").mode("overwrite").save()
    # Bounds cut the ranges only: ids outside them and null ids are read too.
    read = store.read_jdbc_posts(spark, url, 10, 30, 4)
    read = read.toDF(*[c.lower() for c in read.columns])
    assert read.rdd.getNumPartitions() == 4 and store.backfill_dry_run(read).first().n == 40
    posts = {r.source_id: r for r in store.backfill_posts(read).collect()}
    assert {(i, r.content) for i, r in posts.items()} == {(str(i), f"c{i}") for i in range(40)}
    assert posts["3"].metadata == '{"points": 1}' and posts["4"].metadata == "{}"
    assert all(r.fetched_at == r.timestamp for r in posts.values())
